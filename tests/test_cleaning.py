import json

import pytest
from model import rows
from pyspark.sql import functions as F

from arbora import build_graph
from arbora.functions import scalars
from arbora.operators import normalize
from arbora.operators.numbering import dense_index
from arbora.sources.dictionary import read_pseudo_dictionary
from arbora.sources.graph import read_graph_document, read_graph_tables, write_graph_tables


@pytest.fixture
def document(spark, tmp_path):
    def read(content):
        path = tmp_path / "graph.json"
        path.write_text(json.dumps(content, indent=1), encoding="utf-8")
        return read_graph_document(spark, str(path))

    return read


def test_document_with_loose_ids(document):
    persons, orgs, links = document(
        {
            "persons": [
                {"id": 0, "label": "zero"},
                {"id": ""},
                {"id": "0", "label": "text zero"},
                {"id": False},
                {"label": "none"},
                {"id": None},
                {"id": 42, "label": "number", "email": "A@x.org", "isBasis": True, "team": {"k": 1}},
            ],
            "orgs": [{"id": "o", "label": "Unit"}],
            "links": [
                {"source": {"id": 42}, "target": "o"},
                {"source": 42, "target": "0"},
                {"source": None, "target": "o"},
                {"source": "42", "target": "o"},
            ],
        }
    )
    g = build_graph(persons, orgs, links)
    assert rows(g.index, "id", "label") == [("0", "text zero"), ("42", "number"), ("o", "Unit")]
    assert rows(g.links, "source", "target", "kind") == [("42", "0", "pp"), ("42", "o", "po")]
    assert rows(g.email_index) == [("a@x.org", "42")]
    record = g.index.filter("id = '42'").select("is_basis", F.col("props").cast("string")).first()
    assert record[0] is True and '"team":{"k":1}' in record[1]


def test_missing_arrays_are_empty(document):
    persons, orgs, links = document({"orgs": [{"id": "o"}]})
    g = build_graph(persons, orgs, links)
    assert rows(g.index, "id") == ["o"] and rows(g.links) == []


def test_repeated_ids(make_graph):
    g = make_graph([{"id": "a", "label": "old"}, "x", {"id": "a", "label": "new"}], [("x", "org x")], [("a", "x"), ("x", "a")])
    assert rows(g.index, "id", "label", "type", "as_person", "as_org") == [
        ("a", "new", "person", True, False),
        ("x", "org x", "org", True, True),
    ]
    assert [r.id for r in g.index.orderBy("ord").collect()] == ["a", "x"]
    assert g.nodes.count() == 4
    # x is an org in the index and still counts as a person id
    assert rows(g.person_org, "person_id", "org_id") == [("a", "x")]
    assert rows(g.links, "source", "target", "kind") == [("a", "x", "po"), ("x", "a", "op")]


def test_links_are_cleaned(make_graph):
    g = make_graph(["a", "b"], [], [("a", "b"), ("a", "b"), ("a", "a"), ("a", "zz"), ("b", "a")])
    assert rows(g.links, "source", "target", "ord") == [("a", "b", 0), ("b", "a", 4)]


def test_roots_and_projection(make_graph):
    g = make_graph(["p", "q"], ["a", "b", "c"], [("a", "b"), ("p", "a"), ("p", "q")])
    assert rows(normalize.org_roots(g.index, g.links)) == ["a", "c"]
    people, drawn = normalize.person_projection(g.index, g.links)
    assert rows(people, "id") == ["p", "q"] and rows(drawn, "source", "target") == [("p", "q")]


def test_attributes_survive_if_one_person_does(spark, make_graph):
    g = make_graph(["a"], [], [])
    schema = "person_id STRING, attr STRING"
    some = spark.createDataFrame([("a", "x"), ("gone", "y")], schema)
    none = spark.createDataFrame([("gone", "y")], schema)
    assert len(rows(normalize.attributes_still_valid(some, g.index))) == 2
    assert rows(normalize.attributes_still_valid(none, g.index)) == []


def test_tables_round_trip(spark, tmp_path, make_graph):
    persons = spark.createDataFrame([("a", "A", None, True, 0)], "id STRING, label STRING, email STRING, is_basis BOOLEAN, ord BIGINT")
    orgs = spark.createDataFrame([("o", "O", 0)], "id STRING, label STRING, ord BIGINT")
    links = spark.createDataFrame([('{"id": "a"}', "o", 0)], "source STRING, target STRING, ord BIGINT")
    for form in ("parquet", "json"):
        base = str(tmp_path / form)
        write_graph_tables(persons, orgs, links, base, form)
        g = build_graph(*read_graph_tables(spark, f"{base}/persons", f"{base}/orgs", f"{base}/links", form))
        assert rows(g.links, "source", "target", "kind") == [("a", "o", "po")]


def test_dictionary(spark, tmp_path):
    path = tmp_path / "pseudo.json"
    path.write_text(
        json.dumps({"names": ["Ann", "Bob"], "organizationalUnits0": [{"name": "Top"}], "organizationalUnits12": [{"name": "Low"}, {"name": "Lower"}], "other": [1]}, indent=1)
    )
    names, orgs = read_pseudo_dictionary(spark, str(path))
    assert rows(names) == [(0, "Ann"), (1, "Bob")]
    assert rows(orgs) == [(0, 0, "Top"), (12, 0, "Low"), (12, 1, "Lower")]


def test_dense_index_over_many_partitions(spark):
    # small partitions would be joined to one otherwise
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _check_dense_index(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _check_dense_index(spark):
    numbers = spark.range(500).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 3 == 0).alias("hot"))
    got = dense_index(numbers, ["k"], ("hot",))
    for hot in (True, False):
        mine = [r for r in got.collect() if r.hot == hot]
        assert [r.idx for r in sorted(mine, key=lambda r: r.k)] == list(range(len(mine)))
    assert sorted(r.idx for r in dense_index(numbers, ["k"]).collect()) == list(range(500))


def _hash(text):
    h = 0
    units = text.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = (h * 31 + units[i] + 256 * units[i + 1]) & 0xFFFFFFFF
    return h


def test_hashes(spark):
    texts = ["", "org-1", "Projektleitung", "ÄÖÜ€", "a😀b", "x" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = df.select("t", scalars.hash32(F.col("t")), scalars.category_hue(F.col("t"))).collect()
    assert got[1][1] == 106007432
    for text, value, hue in got:
        assert value == _hash(text)
        assert hue == int((value % 360) / 40 + 0.5) * 40 % 360


def test_small_functions(spark):
    df = spark.createDataFrame([("  a﻿\r", '{"id": 42}', None, "kitten", "sitting")], "a STRING, b STRING, c STRING, d STRING, e STRING")
    got = df.select(
        scalars.trimmed(F.col("a")),
        scalars.id_of(F.col("b")),
        scalars.id_of(F.col("c")),
        scalars.id_of(F.lit(7)),
        scalars.edit_distance(F.col("d"), F.col("e")),
        F.round(scalars.similarity(F.col("d"), F.col("e")), 4),
        scalars.similarity(F.lit(""), F.lit("")),
        scalars.level_band(F.lit(2)),
        scalars.level_band(F.lit(999)),
        scalars.palette_colour(F.lit(6), "red")["hue"],
        scalars.palette_colour(F.lit(6), "gray")["lightness"],
    ).first()
    assert tuple(got) == ("a", "42", "null", "7", 3, 0.5714, 1.0, "mid", "low", 10.0, 45)
    with pytest.raises(ValueError):
        scalars.palette_colour(F.lit(1), "none")


def test_collation_is_not_byte_order(spark):
    df = spark.createDataFrame([("b",), ("B",), ("a",), ("ä",), ("Z",)], "t STRING")
    assert [r.t for r in df.orderBy(scalars.collate(F.col("t"))).collect()] == ["a", "ä", "b", "B", "Z"]


def test_reload_in_one_step(spark, make_graph, tmp_path, monkeypatch):
    """What a reload keeps and clears, and that a reader never sees half of one."""
    from arbora.operators.attributes import AttributeStore
    from arbora.operators.visibility import Hidden
    from arbora.plans import reload as R
    from arbora.schema import LINK_FIELDS, ORG_FIELDS, PERSON_FIELDS

    graph = make_graph(["a", "b"], ["o"], [("a", "b"), ("b", "o")])
    attrs = spark.createDataFrame([("a", "c", "x", "1", 0, 0, 0)], "person_id STRING, category STRING, attr STRING, value STRING, batch BIGINT, first_ord BIGINT, ord BIGINT")
    types = spark.createDataFrame([("c", "x", 0, False)], "category STRING, attr STRING, ordinal BIGINT, active BOOLEAN")
    registry = spark.createDataFrame([("c", "c.txt", None, "comma", False, True)], "category STRING, filename STRING, url STRING, format STRING, is_empty BOOLEAN, modified BOOLEAN")
    hidden = Hidden(spark.createDataFrame([("a", "b")], "root_id STRING, node_id STRING"), spark.createDataFrame([("a",)], "root_id STRING"), True)
    base = str(tmp_path / "session")
    R.save_session(R.Session(graph, AttributeStore(attrs, types, registry), hidden, spark.createDataFrame([("o",)], "org_id STRING")), base)

    def data(*ids):
        persons = spark.createDataFrame([(i, None, None, False, n) for n, i in enumerate(ids)], PERSON_FIELDS)
        return persons, spark.createDataFrame([("o", None, 0)], ORG_FIELDS), spark.createDataFrame([(i, "o", n) for n, i in enumerate(ids)], LINK_FIELDS)

    kept = R.reload(spark, base, *data("a", "z"))
    assert rows(kept.graph.index, "id") == ["a", "o", "z"] and rows(kept.attributes.types, "attr", "active") == [("x", False)]
    assert rows(kept.hidden.by_root) == [] and rows(kept.allowed) == []
    assert rows(kept.hidden.shown_roots) == ["a"] and kept.hidden.show_all

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(R.Manifest, "write", lost)
        with pytest.raises(OSError):
            R.reload(spark, base, *data("q"))
    assert rows(R.open_session(spark, base).graph.index, "id") == ["a", "o", "z"]
    gone = R.reload(spark, base, *data("q"))
    assert [rows(t) for t in (gone.attributes.person_attr, gone.attributes.types, gone.attributes.registry)] == [[], [], []]
    assert rows(R.open_session(spark, base).graph.index, "id") == ["o", "q"]
