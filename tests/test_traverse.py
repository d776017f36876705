import os

import pytest
from model import depth_of, lowest_orgs, many_graphs, parents, random_graph, rows, walk, with_managers
from pyspark.sql import functions as F

from arbora.operators import closure, subgraph, traverse
from arbora.operators.visibility import Hidden
from arbora.session import materialize, scope


def test_report_subtree_follows_reports_only(make_graph, roots_of):
    g = make_graph(["m", "r1", "r2", "s1"], ["o"], [("m", "r1"), ("m", "r2"), ("r1", "s1"), ("s1", "o")])
    got = rows(traverse.report_subtree(g, roots_of("m", "nobody")), "root_id", "id")
    assert got == [("m", "m"), ("m", "r1"), ("m", "r2"), ("m", "s1"), ("nobody", "nobody")]


def test_undirected_edges_need_no_known_ends(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c")], "source STRING, target STRING")
    assert rows(traverse.undirected_edges(links)) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]


def test_last_manager_wins(make_graph):
    g = make_graph(["a", "b", "c"], [], [("a", "c"), ("b", "c"), ("a", "b")])
    assert rows(traverse.manager_of(g.links)) == [("b", "a"), ("c", "b")]


def test_org_depth_with_cycle_and_tail(make_graph):
    g = make_graph([], ["x", "y", "z", "t", "u", "v"], [("x", "y"), ("y", "z"), ("z", "x"), ("z", "t"), ("u", "v")])
    assert dict(rows(traverse.org_depth(g))) == {"x": 3, "y": 3, "z": 3, "t": 4, "u": 0, "v": 1}


def test_two_parents(make_graph, roots_of):
    g = make_graph([], ["a", "b", "c"], [("a", "c"), ("b", "c")])
    assert rows(g.org_parent) == [("c", "b")]
    assert rows(traverse.org_descendants(g, roots_of("a", "b")), "root_id", "id") == [
        ("a", "a"),
        ("a", "c"),
        ("b", "b"),
        ("b", "c"),
    ]


def test_descendants_on_a_cycle_end(make_graph, roots_of):
    g = make_graph([], ["a", "b"], [("a", "b"), ("b", "a")])
    assert rows(traverse.org_descendants(g, roots_of("a"), include_root=False), "id") == ["b"]


def test_only_direct_parents_are_eliminated(make_graph, roots_of):
    links = [("w", "r"), ("r", "n"), ("p", "w"), ("p", "n"), ("q", "r"), ("q", "n"), ("p", "q")]
    g = make_graph(["p", "q"], ["w", "r", "n"], links)
    both = traverse.legend_orgs(g, traverse.typed_bfs(g, roots_of("p"), 1, "down"))
    assert rows(both, "org_id", "level") == [("n", 0), ("w", 0)]


def test_persons_with_one_label_twice(make_graph):
    g = make_graph(["p"], [("w", "Top"), ("r", "Same"), ("n", "Same")], [("w", "r"), ("r", "n"), ("p", "n"), ("p", "r")])
    got = traverse.person_all_orgs(g, traverse.org_depth(g))
    assert [(r.org_id, r.label) for r in got.collect()] == [("n", "Same"), ("w", "Top")]


def test_levels_from_roots(make_graph, roots_of):
    g = make_graph(["a", "b", "c", "lone"], [], [("b", "a"), ("b", "c")])
    got = traverse.levels_from_roots(g.index, roots_of("a", "ghost"), g.links)
    assert dict(rows(got)) == {"a": 0, "b": 1, "c": 2, "lone": 999}


def test_no_hierarchy_level_in_a_manager_cycle(make_graph):
    g = make_graph(["a", "b", "c", "d"], ["o"], [("a", "b"), ("b", "a"), ("c", "d"), ("d", "o")])
    assert dict(rows(traverse.hierarchy_levels(g, g.index, g.links))) == {"c": 0, "d": 1, "o": -1}


@pytest.mark.parametrize("pairs, expected", [
    ([("b", "c"), ("a", "b")], ["a", "b", "c"]),
    ([("a", "b"), ("b", "c")], ["b", "c"]),
])
def test_managers_return_in_link_order(make_graph, roots_of, pairs, expected):
    people = [{"id": "a", "basis": True}, {"id": "b", "basis": True}, {"id": "c"}]
    g = make_graph(people, [], pairs)
    sub = subgraph.compute_subgraph(g, roots_of("c"), 0, "both", management=True)
    assert rows(sub.nodes, "id") == expected


def test_nothing_kept_brings_nobody_back(make_graph, roots_of):
    g = make_graph([{"id": "a", "basis": True}, {"id": "b", "basis": True}], [], [("a", "b")])
    assert rows(subgraph.compute_subgraph(g, roots_of("b"), 0, "up", management=True).nodes, "id") == []


@pytest.fixture(scope="module")
def many(make_graph):
    persons, orgs, links = many_graphs(range(25))
    return make_graph(persons, orgs, links), persons, orgs, links


def test_random_org_depths_match_the_model(many):
    g, _, orgs, links = many
    parent = parents(links)
    assert dict(rows(traverse.org_depth(g))) == {o: depth_of(o, parent) for o in orgs}


@pytest.mark.parametrize("mode, depth", [("down", 3), ("up", 2), ("both", 1), ("both", 3)])
def test_random_graphs_match_the_model(many, roots_of, mode, depth):
    g, persons, _, links = many
    starts = [f"{kind}{seed}.{n}" for seed in range(25) for kind, n in (("p", 0), ("o", 0), ("p", 3))]
    reach = traverse.typed_bfs(g, roots_of(*starts, "ghost"), depth, mode)
    model = {root: walk(links, root, depth, mode) for root in starts}
    assert rows(reach, "root_id", "id", "level") == sorted((r, n, v) for r, m in model.items() for n, v in m.items())

    legend = traverse.legend_orgs(g, reach)
    assert rows(legend, "root_id", "org_id", "level") == sorted(
        (r, o, v) for r, m in model.items() for o, v in lowest_orgs(links, m).items()
    )
    managed = subgraph.compute_subgraph(g, roots_of(*starts), depth, mode, management=True)
    kept = {r: with_managers(links, persons, m, mode) for r, m in model.items()}
    assert rows(managed.nodes, "root_id", "id", "level") == sorted(
        (r, n, model[r].get(n, 0)) for r, names in kept.items() for n in names
    )
    assert rows(managed.links, "root_id", "source", "target") == sorted(
        (r, s, t) for r, names in kept.items() for s, t in links if s in names and t in names
    )


def test_hubs_are_split_without_changing_the_result(make_graph, roots_of, monkeypatch):
    persons, orgs, links = random_graph(42, people=30, units=3, links=150)
    links = links + [(p["id"], "o42.0") for p in persons if (p["id"], "o42.0") not in links]
    g = make_graph(persons, orgs, links)
    monkeypatch.setattr(closure.prepare_edges, "__defaults__", ("edges", 4))
    reach = traverse.typed_bfs(g, roots_of("o42.0", "p42.1"), 3, "both")
    hubs = g.edges("both").hubs
    assert hubs is not None and max(rows(hubs, "slots")) > 1
    model = {root: walk(links, root, 3, "both") for root in ("o42.0", "p42.1")}
    assert rows(reach, "root_id", "id", "level") == sorted((r, n, v) for r, m in model.items() for n, v in m.items())


def test_merge_takes_the_level_of_the_last_root(make_graph, roots_of):
    g = make_graph(["a", "b", "c"], ["o"], [("a", "b"), ("b", "c"), ("c", "o")])
    roots = roots_of("c", "a")
    merged = subgraph.merge_roots(g, subgraph.compute_subgraph(g, roots, 2, "both"), roots)
    assert dict(rows(merged.nodes, "id", "level")) == {"a": 0, "b": 1, "c": 2, "o": 1}
    assert rows(subgraph.scope_allowed_orgs(g, merged)) == ["o"]


def test_hidden_nodes_leave_and_do_not_return(spark, make_graph, roots_of):
    g = make_graph(["a", {"id": "b", "basis": True}, "c"], [], [("a", "b"), ("b", "c")])
    by_root = spark.createDataFrame([("a", "b"), ("a", "c")], "root_id STRING, node_id STRING")
    none = spark.createDataFrame([], "root_id STRING")
    sub = subgraph.compute_subgraph(g, roots_of("a"), 3, "down", hidden=Hidden(by_root, none))
    assert rows(sub.nodes, "id") == ["a"] and rows(sub.hidden_count) == [("a", 2)]
    shown = subgraph.compute_subgraph(g, roots_of("a"), 3, "down", hidden=Hidden(by_root, roots_of("a")))
    assert rows(shown.nodes, "id") == ["a", "b", "c"]
    everything = subgraph.compute_subgraph(g, roots_of("a"), 3, "down", hidden=Hidden(by_root, none, show_all=True))
    assert rows(everything.nodes, "id") == ["a", "b", "c"]


def test_diff_steps(make_graph, roots_of):
    g = make_graph(["a", "b", "c", "d", "e"], [], [("a", "b"), ("b", "c"), ("a", "d"), ("d", "e")])

    def view(root, depth):
        table = roots_of(root)
        return subgraph.merge_roots(g, subgraph.compute_subgraph(g, table, depth, "down"), table)

    nodes, links = subgraph.subgraph_diff(view("b", 1), view("a", 2), roots_of("a", "b"))
    assert rows(nodes, "id", "change", "from_step", "to_step") == [
        ("a", "added", 1, None),
        ("b", "kept", 0, None),
        ("c", "kept", 0, None),
        ("d", "added", 2, None),
        ("e", "added", 3, None),
    ]
    assert ("b", "c", 0, None) in rows(links) and ("d", "e", 3, None) in rows(links)
    back, gone = subgraph.subgraph_diff(view("a", 2), view("b", 1), roots_of("a", "b"))
    assert dict(rows(back, "id", "to_step")) == {"a": 2, "b": None, "c": None, "d": 1, "e": 0}
    assert dict(((s, t), last) for s, t, _, last in rows(gone))[("d", "e")] == 0


def test_depth_and_direction_only_add_nodes(make_graph, roots_of):
    persons, orgs, links = random_graph(7, people=20, links=40)
    g = make_graph(persons, orgs, links)
    sizes = [len(rows(traverse.typed_bfs(g, roots_of("p7.0"), d, "both"))) for d in (0, 1, 2, 3)]
    assert sizes[0] == 1 and sizes == sorted(sizes)
    for mode in ("down", "up"):
        assert len(rows(traverse.typed_bfs(g, roots_of("p7.0"), 3, mode))) <= sizes[3]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _above(tree, n):
    """The operators between a line of a plan and the next join above it."""
    place = lambda line: len(line) - len(line.lstrip(" :+-"))
    found, at = [], place(tree[n])
    for line in reversed(tree[:n]):
        if place(line) < at:
            if "Join" in line:
                return found
            found, at = [*found, line], place(line)
    return found


@pytest.mark.parametrize("hubs", [False, True])
def test_edges_and_visited_stay_where_they_are(spark, many, roots_of, no_broadcast, hubs):
    g, _, _, links = many
    edges = closure.prepare_edges(g._edge_plan("both"), "edges", 4 if hubs else 1 << 40)
    assert (edges.hubs is not None) == hubs
    starts = [f"p{seed}.0" for seed in range(25)]
    seeds = roots_of(*starts).select("root_id", F.col("root_id").alias("id"), F.lit(False).alias("org_start"))
    admit = ~F.col("from_org")
    reach = closure.frontier_closure(edges, seeds, 3, admit, ("org_start",)).df
    model = {root: walk(links, root, 3, "both") for root in starts}
    assert rows(reach, "root_id", "id", "level") == sorted((r, n, v) for r, m in model.items() for n, v in m.items())
    seen = closure.Bucketed(seeds, "seen", closure.KEYS, edges.buckets, step="level")
    seen.add(seeds, 0)
    for level in range(3):
        fresh = closure.next_level(seen.at(level), edges, seen.df, admit, ("org_start",))
        tree = fresh._jdf.queryExecution().executedPlan().toString().splitlines()
        scans = [n for n, line in enumerate(tree) if "FileScan parquet" in line]
        # the first scan is the frontier; what lies between another one and its join is no shuffle
        for n in (n for n in scans[1:] if "Bucketed: true" in tree[n]):
            above = _above(tree, n)
            assert not any("Exchange" in line for line in above), "\n".join(tree)
        assert sum("Bucketed: true" in tree[n] for n in scans) >= 2
        seen.add(fresh, level + 1)


def test_a_long_chain_takes_few_rounds(spark):
    from arbora.operators import doubling

    n = 4000
    parents = spark.range(n).selectExpr("CAST(id + 1 AS STRING) AS child", "CAST(id AS STRING) AS parent")
    found = doubling.walks(parents)
    assert found.rounds <= 13 and found.endless_rows == 0
    assert found.rooted.agg(F.max("steps"), F.min("root"), F.count("*")).first() == (n, "0", n)


def test_walks_with_cycles(spark):
    """Cycles of several lengths with tails, and walks that end, against single steps."""
    from arbora.operators import doubling

    up = {"a": "b", "b": "c", "c": "a", "t1": "a", "t2": "t1", "self": "self", "s1": "self", "x": "y", "y": "x", "r1": "root", "r2": "r1", "r3": "r2"}
    up |= {f"l{n}": f"l{(n + 1) % 37}" for n in range(37)} | {f"m{n}": f"m{n - 1}" if n else "l5" for n in range(90)}
    parents = spark.createDataFrame(list(up.items()), "child STRING, parent STRING")
    assert dict(rows(doubling.walk_lengths(parents))) == {i: depth_of(i, up) for i in up}
    starts = ["t2", "m89", "r3", "root", "nobody", "y"]
    expected = []
    for start in starts:
        seen, at = {}, start
        while at not in seen:
            seen[at] = len(seen)
            if at not in up:
                break
            at = up[at]
        expected += [(start, i, n) for i, n in seen.items()]
    asked = spark.createDataFrame([(s,) for s in starts + ["t2"]], "id STRING")
    assert rows(doubling.ancestor_pairs(parents, asked)) == sorted(expected)
    assert rows(doubling.ancestor_set(parents, asked)) == sorted({i for _, i, _ in expected})


def test_a_scope_removes_what_it_wrote(spark):
    with scope(spark):
        inner = materialize(spark.range(3), "inner")
        assert os.path.isdir(inner.path.removeprefix("file:"))
    assert not os.path.exists(inner.path.removeprefix("file:"))


def test_stored_tables_know_their_size(spark):
    assert materialize(spark.range(10).filter("id > 99"), "none").rows == 0
    assert materialize(spark.range(10).filter(F.lit(False)), "none").rows == 0
    assert materialize(spark.range(10), "ten").rows == 10
