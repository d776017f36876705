"""Planted copies of items, whole and edited, and texts without any."""

import random

import numpy as np
import pytest

from arbora.llm import decontaminate as dc
from arbora.llm import queries

WORDS = [f"word{n}x" for n in range(500)]


# No two of these begin alike.
APART = [f"{n:03d}0word" for n in range(500)]


def _text(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(5)
    items = [(n, _text(rng, 30)) for n in range(12)] + [(50, None), (51, "too short"), (None, _text(rng, 30)), (52, "")]
    docs, expected = [], {}
    for n in range(60):
        words = _text(rng, rng.choice([0, 40, 300])).split()
        if n % 3 == 0:
            item = n // 3 % 12
            copy = items[item][1].split()
            if n % 2:  # edited: some words changed, some left out, some put in
                for at in (4, 12, 20):
                    copy[at] = "other"
                del copy[8]
                copy.insert(16, "more")
            words[len(words) // 2 : len(words) // 2] = copy
            expected[n] = item
        docs.append((n, " ".join(words).upper() if n % 4 == 0 else " ".join(words)))
    return items, docs + [(100, None), (101, ""), (None, items[0][1]), (102, items[1][1] + " x " + _text(rng, 90) + " " + items[1][1])], expected


def test_planted_copies(spark, planted):
    items, docs, expected = planted
    df = spark.createDataFrame([(*d, "own", 1) for d in docs], "doc_id BIGINT, text STRING, leaks STRING, item_id INT")
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    got = dc.flag(df, bench)
    assert got.columns == ["doc_id", "text", "item_id", "leaks"]
    rows = {r.doc_id: r for r in got.collect()}
    assert {i: {x.item_id for x in r.leaks} for i, r in rows.items() if r.leaks} == {
        **{i: {k} for i, k in expected.items()},
        None: {0},
        102: {1},
    }
    assert len(rows[102].leaks) == 2 and rows[102].leaks[0].score == 1.0 and rows[102].leaks[1].words == 30


def test_several_passes_agree(spark, planted, monkeypatch):
    items, docs, _ = planted
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    once = {r.doc_id: sorted(map(tuple, r.leaks)) for r in dc.flag(df, bench).collect()}
    monkeypatch.setattr(dc, "ITEM_BYTES", 800)
    assert {r.doc_id: sorted(map(tuple, r.leaks)) for r in dc.flag(df, bench).collect()} == once


def test_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert dc.flag(df, bench).first().leaks == []
    assert dc.flag(df.limit(0), bench).count() == 0


def test_align_against_plain_dynamic_programming():
    rng = random.Random(1)
    for _ in range(30):
        a, b = ([rng.choice(["alpha", "alphas", "beta", "c", "d"]) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        table = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                same = dc.MATCH if x == y else dc.ALIKE if min(len(x), len(y)) > 4 and x[:4] == y[:4] else dc.MISMATCH
                table[i + 1][j + 1] = max(0.0, table[i][j] + same, table[i][j + 1] + dc.GAP, table[i + 1][j] + dc.GAP)
        assert dc.align(a, b)[0] == max(map(max, table))


def test_query_finds_every_whole_item(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, u in items.items() if u in t}
    assert whole <= {(r.doc_id, r.item_id) for r in queries.op1_decontaminate(spark, sf).collect()}


def test_edited_copies_of_an_item_with_many_copies(spark):
    """An item in a third of all rows, one edit of it alone and another in a large group."""
    rng = random.Random(8)
    item = _text(rng, 30).split()
    edits = [list(item) for _ in range(2)]
    for edit, first in zip(edits, (4, 2), strict=True):
        edit[first::5] = ["other"] * len(edit[first::5])
    docs = [(n, _text(rng, 20) + " " + " ".join(item) + " " + _text(rng, 20)) for n in range(100)]
    docs += [(100 + n, _text(rng, 60)) for n in range(130)]
    docs += [(300, _text(rng, 20) + " " + " ".join(edits[0]))] + [(400 + n, " ".join(edits[1]) + " " + _text(rng, 20)) for n in range(69)]
    got = dc.flag(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame([(1, " ".join(item))], "item_id BIGINT, text STRING"))
    found = {r.doc_id for r in got.collect() if r.leaks}
    assert found == {*range(100), 300, *range(400, 469)}


@pytest.mark.parametrize("gap", [0, 1, 5, 20, 40])
def test_copies_next_to_each_other(gap):
    rng = random.Random(gap)
    item = _text(rng, 30, APART).split()
    between = [f"filler{n}" for n in range(gap)]
    words = _text(rng, 50, APART).split()
    for _ in range(3):
        words += [*item, *between]
    seeds = dc.Seeds([(1, " ".join(item))])
    rare = dc.rare_seeds(seeds, np.ones(len(seeds.codes), np.int64), 100)
    found = dc.passages(seeds, rare, words + _text(rng, 50, APART).split(), dc.LEAST_SCORE)
    assert [(f["first_word"], f["words"]) for f in found] == [(50 + k * (30 + gap), 30) for k in range(3)]


def test_very_long_texts_and_repeated_rows(spark):
    rng = random.Random(3)
    item = _text(rng, 30, APART)
    many = " ".join([item] * 1000)
    long = " ".join([_text(rng, 300_000, APART), item, _text(rng, 200_000, APART), item])
    docs = [(1, many), (2, long), (3, item), (3, item), (4, "word1x " * 300_000)]
    got = dc.flag(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame([(7, item)], "item_id BIGINT, text STRING"))
    counts = sorted((r.doc_id, len(r.leaks)) for r in got.collect())
    assert counts == [(1, 1000), (2, 2), (3, 1), (3, 1), (4, 0)]


def test_every_third_word_changed():
    rng = random.Random(9)
    item = _text(rng, 45, APART).split()
    for first in range(3):
        copy = list(item)
        copy[first::3] = [f"new{n}" for n in range(len(copy[first::3]))]
        seeds = dc.Seeds([(1, " ".join(item))])
        rare = dc.rare_seeds(seeds, np.ones(len(seeds.codes), np.int64), 100)
        assert [f["item_id"] for f in dc.passages(seeds, rare, copy, 0.45)] == [1]


def test_against_the_alignment_of_all_pairs(spark, sf):
    docs = [(r.doc_id, dc.words_of(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, dc.words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    wanted = set()
    for doc, text in docs:
        for item, words in items:
            if len(words) >= dc.LEAST_WORDS and dc.align(words, text)[0] >= dc.LEAST_SCORE * dc.MATCH * len(words):
                wanted.add((doc, item))
    found = {(r.doc_id, r.item_id) for r in queries.op1_decontaminate(spark, sf).collect()}
    print("recall", len(found & wanted) / len(wanted), len(wanted))
    assert found <= wanted and len(found & wanted) >= 0.9 * len(wanted)
