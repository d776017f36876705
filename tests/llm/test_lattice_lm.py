"""Marginals against all segmentations, totals against plain counting."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import lattice_lm as lm
from arbora.llm import queries

PATH = queries.vocabulary(queries.PIECES)


@pytest.fixture(scope="module")
def small():
    text = [b" a", b" ab", b" b", b"a", b"b", b"ab", b"ba", b"c", b" c"]
    initial = np.array([t[:1] == b" " for t in text])
    p = np.array([0.3, 0.3, 0.3, 0.2, 0.2, 0.3, 0.2, 0.1, 0.1])
    return lm.Pieces(text, initial, np.log(p), math.log(0.4))


def _all_ways(word, pieces):
    table = {(t.lstrip(b" "), bool(i)): math.exp(p) for t, i, p in zip(pieces.text, pieces.initial, pieces.log_p, strict=True)}
    stop, total, uses = math.exp(pieces.log_stop), 0.0, Counter()
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        ends = [n + 1 for n, c in enumerate(cuts) if c] + [len(word)]
        parts = [(word[a:b], a == 0) for a, b in zip([0, *ends], ends, strict=False)]
        p = stop * math.prod(table.get(x, 0.0) * (1.0 if x[1] else 1 - stop) for x in parts)
        total += p
        for x in parts:
            uses[x] += p
    return total, {x: u / total for x, u in uses.items() if u}


def test_forward_and_expected_counts(small):
    words = [b"a", b"ab", b"abab", b"babac", b"cc", b"abbaabab"]
    got = lm.spell(words, small)
    uses, _ = lm.expected(words, np.ones(len(words)), small)
    wanted = Counter()
    for word, value in zip(words, got, strict=True):
        total, counts = _all_ways(word, small)
        assert value == pytest.approx(math.log(total))
        wanted.update(counts)
    for n, (t, i) in enumerate(zip(small.text, small.initial, strict=True)):
        assert uses[n] == pytest.approx(wanted.get((t.lstrip(b" "), bool(i)), 0.0))


def test_every_word_has_a_segmentation():
    pieces = lm.vocabulary_pieces(PATH)
    words = ["the".encode(), "日本語".encode(), bytes([0xFF, 0x00]), b"a" * 5000, "▁x".encode(), b"qzj"]
    assert np.isfinite(lm.spell(words, pieces)).all()
    for kind in (False, True):
        assert np.exp(pieces.log_p[pieces.initial == kind]).sum() == pytest.approx(1.0)


def _plain(rows):
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    out = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in words}
    counts = Counter(w for i, ws in words.items() if not out[i] for w in ws)
    ends = sum(not o for o in out.values())
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    log = lambda c: math.log10((c + 1) / (n + v + 1))
    return {i: (out[i], len(ws) + 1, sum(counts[w] > 0 for w in ws) + (ends > 0), n, sum(log(counts[w]) for w in ws) + log(ends)) for i, ws in words.items()}


def _check(rows, got):
    for r in got:
        held, tokens, known, total, base = _plain(rows)[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r.score) and r.score <= 0


def test_odd_texts(spark):
    texts = [None, "", " \x0b ", "A a\x0cA", "word " * 5000, "x" * 20_000, "é É \x85\u00a0", "same text", "same text"]
    rows = list(enumerate(texts)) + [(None, "no id")]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id BIGINT, text STRING, score STRING, row INT")
    got = lm.score_texts(df, PATH, queries.fold("doc_id", 7) == 2)
    assert got.columns == ["doc_id", "text", "row", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    _check(rows, got.collect())


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some words")], "doc_id BIGINT, text STRING")
    r = lm.score_texts(df, PATH, F.lit(True)).first()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and math.isfinite(r.score)
    assert lm.score_texts(df.limit(0), PATH, F.lit(True)).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op5_lattice_lm(spark, sf).collect()
    assert len(got) == len(rows)
    _check(rows[:0] or rows, got[:40])


def test_the_table_of_pieces_is_made_once():
    pieces = lm.vocabulary_pieces(queries.vocabulary(queries.SUBWORDS)) if hasattr(queries, "SUBWORDS") else None
    pieces = pieces or lm.Pieces([b" a", b"a", b"b"], np.array([True, False, False]), np.log(np.array([1.0, 0.5, 0.5])))
    again = lm.Pieces(**lm._plain(pieces))
    assert again.slots is pieces.slots and again.at is pieces.at and again.probes == pieces.probes
