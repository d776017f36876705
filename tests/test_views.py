import random

import numpy as np
import pytest
from model import rows
from pyspark.sql import functions as F

from arbora.operators import legend, members, pseudonym, search, spatial, traverse, visibility
from arbora.session import rows_of

MEMBER = "root_id STRING, person_id STRING, org_id STRING, ord BIGINT, x DOUBLE, y DOUBLE"


def orgs(spark, *ids):
    return rows_of(spark, [(i,) for i in ids], "org_id STRING")


def test_membership_per_link_and_root(spark, make_graph):
    g = make_graph(["p", "q"], ["w", "a", "b"], [("w", "a"), ("w", "b"), ("p", "a"), ("p", "b"), ("q", "a")])
    pos = spark.createDataFrame([("p", 1.0, 2.0), ("q", None, 2.0)], "id STRING, x DOUBLE, y DOUBLE")
    got = members.cluster_memberships(g, orgs(spark, "w", "a", "ghost"), pos)
    assert rows(got, "root_id", "person_id", "org_id") == [("a", "p", "a"), ("w", "p", "a"), ("w", "p", "b")]
    depth = traverse.org_depth(g)
    assert [r.org_id for r in members.cluster_order(got, depth).collect()] == ["w", "a"]
    assert rows(members.primary_org(g.person_org, depth)) == [("p", "a", 1), ("q", "a", 1)]


def test_hull_shapes(spark):
    data = [("one", "a", 0, 1.0, 2.0), ("two", "b", 5, 3.0, 0.0), ("two", "a", 4, 0.0, 0.0)]
    data += [("same", "a", n, 1.0, 1.0) for n in range(2)]
    data += [("line", "a", n, float(n), float(n)) for n in range(5)]
    data += [("square", "a", n, x, y) for n, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0), (0, 0)])]
    df = spark.createDataFrame([(r, p, "o", n, float(x), float(y)) for r, p, n, x, y in data], MEMBER).repartition(5)
    got = {r.root_id: (r.n, [tuple(p) for p in r.points]) for r in spatial.hull_vertices(df).collect()}
    assert got["one"] == (1, [(1.0, 2.0)]) and got["two"] == (2, [(0.0, 0.0), (3.0, 0.0)])
    assert got["same"] == (2, [(1.0, 1.0)] * 2) and got["line"] == (5, [])
    assert got["square"] == (7, [(2.0, 2.0), (2.0, 0.0), (0.0, 0.0), (0.0, 2.0)])
    polygon = {r.root_id: [tuple(p) for p in r.polygon] for r in spatial.group_hull(df).collect()}
    assert len(polygon["one"]) == 12 and polygon["one"][0] == (21.0, 2.0)
    assert polygon["two"] == [(0.0, 20.0), (3.0, 20.0), (3.0, -20.0), (0.0, -20.0)]
    assert polygon["same"] == [(1.0, 1.0)] * 4 and polygon["line"] == []
    step = 12 / 2**0.5
    assert polygon["square"][0] == pytest.approx((2 + step, 2 + step))


def _area_test(polygon, x, y):
    inside = False
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        if (ay > y) != (by > y) and x < (ax - bx) * (y - by) / (ay - by) + bx:
            inside = not inside
    return inside


def test_points_in_random_polygons(spark):
    rng = random.Random(3)
    shapes = {f"h{i}": [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(rng.randint(3, 9))] for i in range(12)}
    for i in range(12):
        x, y, r = rng.uniform(0, 100), rng.uniform(0, 100), 10 ** rng.uniform(-1, 1)
        shapes[f"small{i}"] = [(x, y), (x + r, y), (x + r, y + r), (x, y + r / 2)]
    shapes["dot"] = [(5.0, 5.0)] * 3
    shapes["flat"] = [(0.0, 50.0), (100.0, 50.0), (50.0, 50.0)]
    points = {f"p{i}": (rng.uniform(-5, 105), rng.uniform(-5, 105)) for i in range(400)}
    hulls = spark.createDataFrame(list(shapes.items()), f"root_id STRING, polygon {spatial.POINTS}")
    where = spark.createDataFrame([(k, *v) for k, v in points.items()], "id STRING, x DOUBLE, y DOUBLE")
    about = spark.createDataFrame([(k, 1, k) for k in shapes], "org_id STRING, depth BIGINT, label STRING")
    allowed = about.filter("org_id <> 'h3'").select("org_id")
    got = rows(spatial.hulls_at_point(where, hulls, allowed, about), "id", "org_id")
    assert got == sorted((p, h) for p, v in points.items() for h, s in shapes.items() if h != "h3" and _area_test(s, *v))


def test_random_hulls(spark):
    rng = np.random.default_rng(5)
    pts = [(f"g{i % 3}", "p", "o", i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 40, (600, 2)))]
    got = spatial.hull_vertices(spark.createDataFrame(pts, MEMBER).repartition(7)).collect()
    for row in got:
        mine = [(p[4], p[5]) for p in pts if p[0] == row.root_id]
        corners = [tuple(p) for p in row.points]
        assert row.n == len(mine)
        for a, b in zip(corners, corners[1:] + corners[:1]):
            turns = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for x, y in mine]
            # every point on one side, and none of a side's inner points is a corner
            assert max(turns) <= 0
        assert len(set(corners)) == len(corners)


def test_search(spark, make_graph):
    people = [{"id": f"p{i}", "label": f"Name {120 - i:03d}"} for i in range(120)] + [{"id": "Bare-ID"}]
    g = make_graph(people, [], [])
    got = search.search_nodes(g, " NAME ").collect()
    assert len(got) == 100 and got[0].truncated
    assert [r.label for r in got] == [f"Name {n:03d}" for n in range(21, 121)]
    assert [(r.label, r.truncated) for r in search.search_nodes(g, "bare").collect()] == [("Bare-ID", False)]
    assert search.search_nodes(g, "n").collect() == []
    assert len(search.search_nodes(g, "p11", limit=3).collect()) == 3


def test_roots_are_limited():
    assert search.add_root(["a"], "b") == ["a", "b"] and search.add_root(["a"], "a") == ["a"]
    assert search.add_root(list("abcde"), "f") == list("abcde")


def test_resolve_by_priority(spark, make_graph):
    g = make_graph([{"id": "x", "label": "same"}, {"id": "same", "label": "y@z"}, {"id": "e", "email": "y@z", "label": "X"}], [], [])
    texts = spark.createDataFrame([(" SAME ",), ("Y@Z",), ("X",), ("?",), ("",), ("E",)], "text STRING")
    assert dict(rows(search.resolve_node(g, texts))) == {" SAME ": "same", "Y@Z": "e", "X": "x", "?": None, "": None, "E": "e"}


def test_legend_repeats_shared_children_and_ends_on_cycles(spark, make_graph):
    g = make_graph([], ["a", "b", "c", "x", "y"], [("a", "c"), ("b", "c"), ("c", "x"), ("x", "y"), ("y", "x")])
    tree = legend.org_legend(g, orgs(spark, "a", "b", "c", "x", "y"), orgs(spark, "c"))
    paths = [r.path.replace(legend.PATH_SEPARATOR, ">") for r in tree.collect()]
    assert paths == ["a", "a>c", "a>c>x", "a>c>x>y", "b", "b>c", "b>c>x", "b>c>x>y"]
    assert rows(tree.filter("visible"), "org_id", "depth", "has_children") == [("c", 1, True)] * 2
    found = legend.org_legend_filter(tree, " X ")
    assert rows(found, "org_id") == ["a", "b", "c", "c", "x", "x"]
    assert len(rows(legend.org_legend_filter(tree, ""))) == 8
    only = legend.org_legend(g, orgs(spark, "c", "y"), orgs(spark))
    assert rows(only, "org_id", "depth", "has_children") == [("c", 0, False), ("y", 0, False)]


def test_hull_switches(spark, make_graph):
    g = make_graph([], ["r", "a", "b", "s"], [("r", "a"), ("a", "b")])
    every = orgs(spark, "r", "a", "b", "s")
    assert rows(legend.toggle_all_hulls(every, every)) == []
    assert rows(legend.toggle_all_hulls(orgs(spark), every)) == ["a", "b", "r", "s"]
    assert rows(legend.toggle_hull(orgs(spark, "a"), orgs(spark, "a", "s"))) == ["s"]
    assert rows(legend.show_hull_subtree(g, orgs(spark, "s"), orgs(spark, "a"))) == ["a", "b", "s"]
    assert rows(legend.hide_hull_subtree(g, every, orgs(spark, "a"))) == ["r", "s"]
    assert rows(legend.only_direct_children(g, every, orgs(spark, "r"))) == ["a", "r", "s"]
    assert rows(legend.restore_hulls(None, every)) == ["a", "b", "r", "s"]
    assert rows(legend.restore_hulls(orgs(spark, "a"), every)) == ["a"]


def test_hiding(spark, make_graph, roots_of):
    g = make_graph(["a", "b", "c", "lone"], [], [("a", "b"), ("b", "c")])
    none = rows_of(spark, [], "root_id STRING, node_id STRING")
    by_root = visibility.hide_subtree(g, none, roots_of("a", "b", "lone"))
    assert rows(by_root) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert rows(visibility.hide_subtree(g, by_root, roots_of("a"))) == rows(by_root)
    left = visibility.unhide_subtree(by_root, roots_of("a"))
    hidden = visibility.Hidden(left, rows_of(spark, [], "root_id STRING"))
    assert dict(rows(visibility.is_hidden(g.index, hidden))) == {"a": False, "b": False, "c": True, "lone": False}
    shown = visibility.toggle_temp_visible(rows_of(spark, [], "root_id STRING"), by_root, roots_of("a", "lone"))
    assert rows(shown) == ["a"]
    assert rows(visibility.toggle_temp_visible(shown, by_root, roots_of("a"))) == []
    both = visibility.Hidden(by_root, shown)
    once = visibility.toggle_hidden(g, both, roots_of("a", "lone"))
    assert rows(once.by_root) == [("b", "c")] and rows(once.shown_roots) == []
    twice = visibility.toggle_hidden(g, once, roots_of("a"))
    assert rows(twice.by_root) == rows(by_root)
    everything = visibility.toggle_show_all(both)
    assert everything.show_all and rows(everything.shown_roots) == []
    assert not visibility.toggle_show_all(everything).show_all
    table = legend.hidden_legend(g, visibility.Hidden(by_root, shown))
    assert rows(table) == [("a", "a", 2, True), ("b", "b", 1, False)]


def test_pseudonyms(spark, make_graph):
    people = [{"id": "1", "label": "Zoe"}, {"id": "2", "label": "Al"}, {"id": "3", "label": "zoe "}, {"id": "4", "label": "Zoe"}]
    g = make_graph(people, [("w", "Top"), ("a", "Mid"), ("b", "Mid2"), ("c", "Deep"), ("d", "Top ")], [("w", "a"), ("w", "b"), ("a", "c"), ("c", "d")])
    names = rows_of(spark, [(0, "N0"), (1, "N1")], "idx BIGINT, name STRING")
    units = rows_of(spark, [(0, 0, "U0"), (0, 1, "U1"), (1, 0, "M0")], "level BIGINT, idx BIGINT, name STRING")
    depth = traverse.org_depth(g)
    shown = dict(rows(pseudonym.display_label(g, depth, (names, units))))
    assert shown == {"1": "N0", "2": "N1", "3": "N0", "4": "N0", "w": "U0", "a": "M0", "b": "M0", "c": "U0", "d": "U0"}
    old = dict(rows(pseudonym.display_label(g, depth, (names, units), variant="old")))
    assert old == {"1": "N0", "2": "N1", "3": "N0", "4": "N0", "w": "U0", "a": "M0", "b": "M0", "c": "U0", "d": "U0"}
    plain = dict(rows(pseudonym.display_label(g, depth, (names, units), enabled=False)))
    assert plain["1"] == "Zoe" and plain == dict(rows(pseudonym.display_label(g, depth, None)))
    nobody = names.filter(F.lit(False))
    assert dict(rows(pseudonym.display_label(g, depth, (nobody, units))))["1"] == "Zoe"
    labels = g.index.filter("type = 'person'")
    folded = dict(rows(pseudonym.pseudonymize_names(labels, names, "old")))
    assert folded == {"Zoe": "N0", "Al": "N1", "zoe ": "N0"}
    assert dict(rows(pseudonym.pseudonymize_names(labels, names))) == {"Zoe": "N0", "Al": "N1", "zoe ": "N0"}


def test_points_are_dealt_out_before_they_meet_the_hulls(spark):
    square = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]
    hulls = spark.createDataFrame([("h", square)], f"root_id STRING, polygon {spatial.POINTS}")
    about = spark.createDataFrame([("h", 1, "h")], "org_id STRING, depth BIGINT, label STRING")
    where = spark.createDataFrame([("p", 1.0, 2.0)], "id STRING, x DOUBLE, y DOUBLE").coalesce(1)
    found = [spatial.hulls_at_point(where, hulls, about, about, ordered) for ordered in (False, True)]
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in found]
    assert "REPARTITION_BY_NUM" in plans[0]
    assert "Join" not in plans[1]  # the sort reads what was found, twice, and does not find it again
    assert [rows(df, "id", "org_id") for df in found] == [[("p", "h")]] * 2
