import pytest
from model import rows
from pyspark.sql import functions as F

from arbora.operators import attributes as A
from arbora.session import rows_of
from arbora.sources import attributes as S
from arbora.streaming.drops import (
    ingest_attribute_drops,
    read_attribute_store,
    read_attribute_types,
    read_category_registry,
)

SAMPLE = "p-1\tAlpha\r\np-2,Beta, Lead \r\n   \r\np-1\tAlpha\tnew\r\nonly one\r\n\tNoId\r\np-3,\r\np-2\tGamma\t\r\nA@x.org,Beta,mail"


def lines_of(spark, text, category="skills"):
    rows_ = [(category, n, line.rstrip("\r")) for n, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows_, "category STRING, ord BIGINT, line STRING")


def test_live_parser(spark):
    got = S.parse_attribute_lines(lines_of(spark, SAMPLE))
    assert rows(got, "identifier", "attr", "value", "ord") == [
        ("", "NoId", "1", 5),
        ("A@x.org", "Beta", "mail", 8),
        ("p-1", "Alpha", "new", 0),
        ("p-2", "Beta", "Lead", 1),
        ("p-2", "Gamma", "", 7),
        ("p-3", "", "1", 6),
    ]


def test_strict_parser_splits_by_the_files_separator(spark):
    got = S.parse_attribute_lines(lines_of(spark, SAMPLE), "strict")
    assert rows(got, "identifier", "attr", "value") == [("p-1", "Alpha", "new"), ("p-2", "Gamma", "1")]


def test_counts_and_registry(spark):
    lines = lines_of(spark, SAMPLE).unionByName(lines_of(spark, " \n\t\n", "later")).withColumn("url", F.concat("category", F.lit(".csv?x=1")))
    files = rows_of(spark, [("skills", "skills.csv?x=1", 1), ("later", "later.csv?x=1", 2), ("void", "http://x/", 3)], "category STRING, url STRING, batch BIGINT")
    assert rows(S.line_counts(lines, files)) == [("later", 0, True), ("skills", 7, False), ("void", 0, True)]
    registry = S.category_registry(lines, files)
    assert rows(registry, "category", "filename", "format", "is_empty") == [
        ("later", "later.csv", "comma", True),
        ("skills", "skills.csv", "tab", False),
        ("void", "void.txt", "comma", True),
    ]
    assert rows(S.empty_categories(registry)) == ["later", "void"]


@pytest.mark.parametrize("path, live, upload", [
    ("http://h/a/skills.de.txt?v=1.2#x", "skills.de", "skills.de.txt?v=1.2#x"),
    ("/d/.hidden", ".hidden", ""),
    ("plain", "plain", "plain"),
    ("/d/ spaced .csv", "spaced", " spaced "),
])
def test_category_names(spark, path, live, upload):
    df = spark.createDataFrame([(path,)], "p STRING")
    got = df.select(S.category_from_path(F.col("p")), S.category_from_file_name(F.col("p"))).first()
    assert got[0] == live
    if "?" not in path:
        assert got[1] == upload


@pytest.fixture
def people(make_graph):
    return make_graph([{"id": "p-1", "email": "a@X.org"}, {"id": "P-2"}, {"id": "p-3", "email": "a@x.org"}, "p-2"], ["o-1"], [])


def test_identifiers(spark, people):
    asked = spark.createDataFrame([("A@x.ORG",), ("P-1",), ("P-2",), ("o-1",), ("?",)], "identifier STRING")
    assert rows(A.resolve_identifiers(people, asked)) == [("A@x.ORG", "p-3"), ("P-1", "p-1"), ("P-2", "p-2")]


def test_the_identifier_that_came_up_last_wins(spark, people):
    text = "a@x.org,T,mail\np-3,T,id\na@x.org,T,mail again\nnobody,T"
    entries = S.parse_attribute_lines(lines_of(spark, text, "c"))
    matched = A.match_attributes(people, entries)
    assert rows(matched.person_attr, "person_id", "attr", "value") == [("p-3", "T", "id")]
    assert rows(matched.unmatched, "identifier") == ["nobody"]
    assert rows(matched.counts, "matched", "unmatched") == [(2, 1)]


ATTR = "person_id STRING, category STRING, attr STRING, value STRING, batch BIGINT, first_ord BIGINT, ord BIGINT"


def test_merge_keeps_position_and_takes_the_new_value(spark):
    old = spark.createDataFrame([("p", "c", "a", "1", 0, 5, 5), ("p", "c", "b", "1", 0, 6, 6)], ATTR)
    new = spark.createDataFrame([("p", "c", "b", "2", 1, 0, 0), ("q", "c", "a", "", 1, 1, 1)], ATTR)
    assert rows(A.merge_attributes(old, new), "person_id", "attr", "value", "batch", "ord") == [
        ("p", "a", "1", 0, 5),
        ("p", "b", "2", 0, 6),
        ("q", "a", "", 1, 1),
    ]


TYPE = "category STRING, attr STRING, ordinal BIGINT, active BOOLEAN"


def test_known_types_still_take_a_place(spark):
    old = spark.createDataFrame([("c", "x", 0, False), ("c", "y", 1, True)], TYPE)
    names = spark.createDataFrame([("c", "new1", 0), ("c", "x", 1), ("c", "new2", 2), ("d", "z", 3)], "category STRING, attr STRING, ord BIGINT")
    got = A.register_attribute_types(old, names)
    assert rows(got) == [("c", "new1", 2, True), ("c", "new2", 4, True), ("c", "x", 0, False), ("c", "y", 1, True), ("d", "z", 0, True)]


def test_switches(spark):
    types = spark.createDataFrame([("c", "x", 0, False), ("c", "y", 1, True), ("d", "z", 0, True)], TYPE)
    on = lambda df: rows(df.filter("active"), "category", "attr")
    assert on(A.toggle_attribute(types, "c", "x")) == [("c", "x"), ("c", "y"), ("d", "z")]
    assert on(A.toggle_all_attributes(types)) == []
    assert len(on(A.toggle_all_attributes(A.toggle_all_attributes(types)))) == 3
    assert on(A.toggle_category(types, "c")) == [("c", "x"), ("c", "y"), ("d", "z")]
    assert on(A.toggle_category(types, "d")) == [("c", "y")]


def test_adding_by_hand(spark, people):
    registry = rows_of(spark, [("c", "c.tsv", None, "tab", False, False)], "category STRING, filename STRING, url STRING, format STRING, is_empty BOOLEAN, modified BOOLEAN")
    store = A.AttributeStore(
        spark.createDataFrame([("p-1", "c", "x", "7", 0, 0, 0)], ATTR), spark.createDataFrame([("c", "x", 0, False)], TYPE), registry
    )
    who = spark.createDataFrame([("p-1",), ("p-3",)], "person_id STRING")
    store = A.add_attribute(A.add_attribute(store, who, "c", "x", 1), who, "new", "n", 2, "v")
    assert rows(store.person_attr, "person_id", "category", "value") == [
        ("p-1", "c", "1"), ("p-1", "new", "v"), ("p-3", "c", "1"), ("p-3", "new", "v"),
    ]
    assert rows(store.types) == [("c", "x", 0, False), ("new", "n", None, True)]
    assert rows(store.registry, "category", "filename", "format", "modified") == [("c", "c.tsv", "tab", True), ("new", "new.txt", "comma", True)]


def test_export_round_trip(spark, people, tmp_path):
    attrs = spark.createDataFrame([("p-3", "c", "b", "9", 0, 0, 0), ("p-2", "c", "a", "1", 0, 0, 1), ("p-2", "d/ä", "z", "1", 0, 0, 2)], ATTR)
    registry = rows_of(spark, [("c", "c.csv", None, "comma", False, True)], "category STRING, filename STRING, url STRING, format STRING, is_empty BOOLEAN, modified BOOLEAN")
    cleared = S.export_category(attrs, people.index, registry, "c", str(tmp_path / "c.csv"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c.csv")).collect()] == ["a@x.org,b", "p-2,a"]
    assert rows(cleared, "modified") == [False]
    path = S.export_category_tsv(attrs, people.index, "d/ä", str(tmp_path))
    assert path.endswith("/d_ä.tsv") and [r.value for r in spark.read.text(path).collect()] == ["p-2\tz"]
    assert S.export_category_tsv(attrs, people.index, "none", str(tmp_path)) is None
    safe = spark.createDataFrame([("d/ä",)], "c STRING").select(S.safe_file_name(F.col("c"))).first()[0]
    assert safe == "d_ä.tsv"


def test_a_double_colon_ends_a_name(spark, people):
    attrs = spark.createDataFrame([("p-1", "c", "x::y", "1", 0, 0, 0)], ATTR)
    types = spark.createDataFrame([("c", "x::y", 0, True)], TYPE)
    registry = rows_of(spark, [("c", "tab", False)], "category STRING, format STRING, is_empty BOOLEAN")
    assert rows(S.export_lines(attrs, people.index, registry)) == [("c", "a@X.org\tx")]
    assert rows(A.attribute_legend(types, registry)) == [("c", "x", True, True)]
    assert rows(A.person_category_flag(people, attrs, types)) == [("p-1", "c", "x")]


def test_files_read_in_line_order_over_many_splits(spark, tmp_path):
    size = 4 << 20
    count = 60_000
    (tmp_path / "big.csv").write_text("".join(f"p-{n},attribute {n} {'x' * 300}\r\n" for n in range(count)))
    (tmp_path / "empty.txt").write_text("")
    with_conf = {"spark.sql.files.maxPartitionBytes": str(size)}
    before = {k: spark.conf.get(k) for k in with_conf}
    try:
        for k, v in with_conf.items():
            spark.conf.set(k, v)
        lines, files = S.read_attribute_files(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 2
        got = [int(r.line.split(",")[0][2:]) for r in lines.orderBy("ord").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == list(range(count))
    assert sorted(r.file.rsplit("/", 1)[1] for r in files.collect()) == ["big.csv", "empty.txt"]


def test_drops_merge_once_and_newest_wins(spark, people, tmp_path):
    folder, store = tmp_path / "in", tmp_path / "store"
    folder.mkdir()
    (folder / "c.csv").write_text("p-1,x,old\np-2,y")
    load = lambda: ingest_attribute_drops(people, str(folder), str(store), parts=S.SPARK_PARTS + "|part-.*").awaitTermination()
    load()
    parts = folder / "again" / "c.csv"
    parts.mkdir(parents=True)
    (parts / "part-00000-x").write_text("p-1,x,first\n")
    (parts / "part-00001-x").write_text("p-1,x,new\np-3,z")
    for _ in range(2):
        load()
    got = read_attribute_store(spark, str(store))
    assert rows(got, "person_id", "category", "attr", "value") == [
        ("p-1", "c", "x", "new"), ("p-2", "c", "y", "1"), ("p-3", "c", "z", "1"),
    ]
    # x is known to the second file and still takes place 0 there
    assert rows(read_attribute_types(spark, str(store)), "category", "attr", "ordinal") == [("c", "x", 0), ("c", "y", 1), ("c", "z", 3)]
    (folder / "later.txt").write_text(" \n\t\n")
    load()
    assert rows(read_category_registry(spark, str(store)), "category", "filename", "format", "is_empty") == [
        ("c", "c.csv", "comma", False), ("later", "later.txt", "comma", True),
    ]


def test_loading_files_one_after_the_other(spark, people, tmp_path):
    from arbora.plans.explore import load_attribute_files, new_attribute_store

    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "c.csv").write_text("p-1,x,old\np-2,y\nnobody,w")
    (tmp_path / "two" / "c.tsv").write_text("p-1\tx\tnew\np-2\tz")
    (tmp_path / "two" / "empty.txt").write_text("")
    first = load_attribute_files(people, new_attribute_store(spark), str(tmp_path), 0)
    assert rows(first.store.person_attr, "person_id", "category", "attr", "value") == [
        ("p-1", "c", "x", "new"), ("p-2", "c", "y", "1"), ("p-2", "c", "z", "1"),
    ]
    assert rows(first.store.types) == [("c", "w", 2, True), ("c", "x", 0, True), ("c", "y", 1, True), ("c", "z", 4, True)]
    assert rows(first.store.registry, "category", "filename", "format", "is_empty") == [
        ("c", "c.tsv", "tab", False), ("empty", "empty.txt", "comma", True),
    ]
    assert rows(first.counts, "category", "batch", "matched", "unmatched") == [("c", 0, 2, 1), ("c", 1, 2, 0)]
    again = load_attribute_files(people, first.store, str(tmp_path / "one"), 10)
    assert ("p-1", "old") in rows(again.store.person_attr.filter("attr = 'x'"), "person_id", "value")
    assert len(rows(again.store.types)) == 4 and rows(again.store.registry, "category", "format") == [("c", "comma"), ("empty", "comma")]


def test_rings_flags_and_legend(spark, people):
    attrs = spark.createDataFrame(
        [("p-1", "c", "b", "1", 0, 0, 1), ("p-1", "c", "a", "5", 0, 0, 2), ("p-1", "h", "a", "1", 0, 0, 3), ("p-2", "c", "off", "1", 0, 0, 4)], ATTR
    )
    types = spark.createDataFrame([("c", "a", 0, True), ("c", "b", 1, True), ("c", "off", 2, False), ("h", "a", 0, True)], TYPE)
    hidden = rows_of(spark, [("h",)], "category STRING")
    shown = A.active_attributes_per_person(people, attrs, types, hidden)
    assert rows(shown, "person_id", "active_count", "extra_rings", "outer_radius") == [
        ("P-2", 0, 0, 9.5), ("p-1", 2, 1, 16.5), ("p-2", 0, 0, 9.5), ("p-3", 0, 0, 9.5),
    ]
    older = A.active_attributes_per_person(people, attrs, types)
    assert rows(older.filter("person_id = 'p-1'"), "active_count") == [3]
    assert [r.key for r in A.active_attribute_list(attrs, types, hidden).collect()] == ["c::a", "c::b"]
    assert rows(A.person_category_flag(people, attrs, types)) == [("p-1", "c", "b"), ("p-1", "h", "a"), ("p-2", "c", "off")]
    assert rows(A.label_visible(people, "attributes", shown).filter("label_visible"), "id") == ["p-1"]
    assert len(rows(A.label_visible(people, "all", shown).filter("label_visible"), "id")) == 5
    assert rows(A.label_visible(people, "none", shown).filter("label_visible"), "id") == []
    registry = rows_of(spark, [("e", True), ("c", False)], "category STRING, is_empty BOOLEAN")
    legend = [tuple(r) for r in A.attribute_legend(types, registry).collect()]
    assert legend == [
        ("c", "a", True, False), ("c", "b", True, False), ("c", "off", False, False), ("e", None, None, None), ("h", "a", True, True),
    ]
    none = spark.createDataFrame([], "person_id STRING, org_id STRING, depth BIGINT, label STRING")
    detail = A.person_detail(people, attrs, types, none, none).filter("person_id = 'p-1'")
    assert [r.text for r in detail.orderBy(F.desc("section"), "rank", "place").collect()] == ["p-1", "c: b", "c: a: 5", "h: a"]


def test_names_decide_nothing(spark, people, tmp_path):
    from arbora.plans.explore import load_attribute_files, new_attribute_store

    folder, store = tmp_path / "in", tmp_path / "store"
    folder.mkdir()
    for name in ("part-time.txt", "Projekt A+B 100% für #1.txt", "_hidden.txt"):
        (folder / name).write_text("p-1,x,1\np-2,y")
    (folder / "none.txt").write_text("")
    loaded = load_attribute_files(people, new_attribute_store(spark), str(folder), 0)
    names = ["Projekt A+B 100% für #1", "part-time"]
    assert sorted({r.category for r in loaded.store.person_attr.collect()}) == names
    assert [i.rsplit("/", 1)[1] for i in loaded.ignored] == ["_hidden.txt"]
    assert rows(loaded.store.registry, "category", "filename", "is_empty") == [
        ("Projekt A+B 100% für #1", "Projekt A+B 100% für #1.txt", False),
        ("none", "none.txt", True),
        ("part-time", "part-time.txt", False),
    ]
    for files_per_batch in (1, None):
        kept = f"{store}-{files_per_batch}"
        ingest_attribute_drops(people, str(folder), kept, files_per_batch).awaitTermination()
        assert rows(read_attribute_store(spark, kept), "category", "person_id", "attr") == [
            (c, p, a) for c in names for p, a in (("p-1", "x"), ("p-2", "y"))
        ]


def test_later_files_of_the_list_win(spark, people, tmp_path):
    from arbora.plans.explore import load_attribute_files, new_attribute_store

    for name, value in (("b", "first"), ("a", "second")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "c.csv").write_text(f"p-1,x,{value}")
    listed = [str(tmp_path / "b"), str(tmp_path / "a")]
    for paths, winner in ((listed, "second"), (listed[::-1], "first")):
        store = load_attribute_files(people, new_attribute_store(spark), paths, 0).store
        assert rows(store.person_attr, "value") == [winner]


def test_attribute_by_hand_on_every_store(spark, people, tmp_path):
    from arbora.operators.attributes import AttributeStore, add_attribute
    from arbora.plans.explore import load_attribute_files, new_attribute_store

    folder, store = tmp_path / "in", tmp_path / "store"
    folder.mkdir()
    (folder / "c.csv").write_text("p-1,x,file\np-2,y")
    persons = spark.createDataFrame([("p-1",)], "person_id STRING")
    ingest_attribute_drops(people, str(folder), str(store)).awaitTermination()
    streamed = AttributeStore(read_attribute_store(spark, str(store)), read_attribute_types(spark, str(store)), read_category_registry(spark, str(store)))
    loaded = load_attribute_files(people, new_attribute_store(spark), str(folder), 0).store
    for kept in (streamed, loaded, new_attribute_store(spark)):
        added = add_attribute(kept, persons, "c", "x", 99, "hand")
        assert ("p-1", "c", "x", "hand") in rows(added.person_attr, "person_id", "category", "attr", "value")
        assert added.person_attr.schema.simpleString() == kept.person_attr.schema.simpleString()
    again = load_attribute_files(people, add_attribute(loaded, persons, "d", "z", 99), str(folder), 200).store
    assert rows(again.person_attr, "category", "person_id", "attr") == [("c", "p-1", "x"), ("c", "p-2", "y"), ("d", "p-1", "z")]


def _three_tables(spark, store):
    attrs = rows(read_attribute_store(spark, store), "person_id", "category", "attr", "value")
    types, registry = read_attribute_types(spark, store), read_category_registry(spark, store)
    return attrs, rows(types, "category", "attr", "ordinal", "active"), rows(registry, "category", "filename", "format", "is_empty")


def test_batches_change_nothing(spark, people, tmp_path, monkeypatch):
    """Parts of a folder and files without content, in batches of one file, of three, and in one."""
    from arbora.sources import slots

    folder = tmp_path / "in"
    for name, parts in {
        "c.csv": ["p-1,x,old\np-2,first", "P2@X.DE,first,mail\nnobody,w", "p-1,x,new\np-1,last", ""],
        "d.tsv": ["p-2\tq", ",", "p-2\ta\t"],
        "none.txt": ["", ""],
        "blank.txt": ["", " \n\t\n"],
    }.items():
        (folder / name).mkdir(parents=True)
        for n, text in enumerate(parts):
            (folder / name / f"part-{n:05d}-x.txt").write_text(text)
    seen = {}
    for batch, most in ((1, 1), (3, 8), (None, 8)):
        monkeypatch.setattr(slots.Slots.compact, "__defaults__", (most,))
        store = str(tmp_path / f"store-{batch}")
        ingest_attribute_drops(people, str(folder), store, batch, parts=S.SPARK_PARTS).awaitTermination()
        seen[batch] = _three_tables(spark, store)
    first = seen.pop(None)
    assert all(other == first for other in seen.values())
    assert ("none", "none.txt", "comma", True) in first[2] and ("blank", "blank.txt", "comma", True) in first[2]
    assert ("p-1", "c", "x", "new") in first[0] and [t[2] for t in first[1] if t[0] == "c"] == [1, 3, 2, 0]


def test_a_batch_that_runs_again(spark, people, tmp_path):
    from arbora.sources.attributes import text_lines
    from arbora.streaming.drops import Drops

    (tmp_path / "c.csv").write_text("p-1,x,1\np-2,y,2")
    lines = text_lines(spark.read.option("lineSep", "\n").text(str(tmp_path / "c.csv")))
    store = str(tmp_path / "store")
    drops = Drops(spark, store)
    for number in (0, 1, 1, 2, 2):
        drops.add(people, lines, number)
    assert rows(read_attribute_store(spark, store), "person_id", "attr", "value") == [("p-1", "x", "1"), ("p-2", "y", "2")]
    assert all(len(folders) == 3 for folders in drops.state()[0].pieces.values())


def test_a_load_reads_only_the_slots_of_its_categories(spark, people, tmp_path):
    from arbora.plans.explore import load_attribute_files, new_attribute_store
    from arbora.sources.slots import slots_of

    for name in ("a", "b", "c", "d"):
        (tmp_path / "one").mkdir(exist_ok=True)
        (tmp_path / "one" / f"{name}.csv").write_text(f"p-1,x,{name}\np-2,y")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "b.csv").write_text("p-1,x,newer")
    store = load_attribute_files(people, new_attribute_store(spark), str(tmp_path / "one"), 0).store
    before = store.slots
    after = load_attribute_files(people, store, str(tmp_path / "two"), 10).store
    (touched,) = slots_of(spark, ["b"])
    assert {s for s in before.pieces if before.pieces[s] != after.slots.pieces[s]} == {touched}
    read = before.read([touched]).inputFiles()
    assert read and all(f"slot={touched}/" in f for f in read)
    assert ("p-1", "b", "newer") in rows(after.person_attr.filter("attr = 'x'"), "person_id", "category", "value")
    assert len(rows(after.person_attr)) == 8


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_a_category_are_not_gathered_and_entries_are_sorted_by_identifier(spark):
    lines = spark.createDataFrame([("c", "p\ta\tv", 1), ("c", "q,a", 2)], "category STRING, line STRING, ord BIGINT")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        strict = S.parse_attribute_lines(lines, "strict")
        assert "BroadcastHashJoin" in _plan(strict) and "SortMergeJoin" not in _plan(strict)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows(strict.drop("ord")) == [("c", "p", "a", "v")]
    assert "SortAggregate(key=[identifier" in _plan(S.parse_attribute_lines(lines))


def test_a_line_of_a_drop_is_one_row(make_graph, spark, tmp_path):
    from arbora.streaming import drops

    (tmp_path / "c.txt").write_text("p,a\np,a,2\nq,b\n")
    lines = S.with_order(S.text_lines(spark.read.text(str(tmp_path))))
    pieces = drops._pieces(make_graph(["p"], [], []), lines)
    assert "Generate" not in _plan(pieces)
    assert rows(pieces.select("category", "identifier", "attr", "value")) == [("c", "p", "a", "2"), ("c", "q", "b", "1")]
