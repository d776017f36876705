"""The filter audit against filters applied one after the other."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from arbora.llm import filter_audit as fa

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, mask INT, n INT, least STRING, a BIGINT"
LABELS = "doc_id BIGINT, quality INT, toxic INT"


def failed(key, text, rows):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    if key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows):
        out.add("E")
    return out


def brute(rows, labels):
    good = {k for k, q, _ in labels if k is not None and q == 1}
    toxic = {k for k, _, t in labels if k is not None and t == 1}
    cases = [(k, lang or "", failed(k, t, rows)) for k, t, lang in rows]
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in cases}:
        mine = [(k, f) for k, p, f in cases if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order):
                gone = [k for k, f in left if letter in f]
                out[part, "".join(order), step + 1] = [
                    len(left) - len(gone), len(gone), sum(letter in f for _, f in mine) - len(gone),
                    sum(f == {letter} for _, f in mine), sum(k in good for k in gone), sum(k in toxic for k in gone), letter,
                ]
                shapley[part, letter] += len(gone)
                left = [(k, f) for k, f in left if letter not in f]
    return sorted((*where, *row[:-1], shapley[where[0], row[-1]]) for where, row in out.items())


def _rows():
    rng = random.Random(6)
    words = [f"word{n}" for n in range(500)]
    texts = [" ".join(rng.sample(words, 230)) for _ in range(12)]
    texts += [t.replace("word1", "WORD1") for t in texts[:5]] + [t + " #" for t in texts[:4]] + ["x y x y " * 70, "short", "a\x0bb\x1fc d " * 90, "\t\n "]
    rows = [(n, rng.choice(texts), rng.choice(["en", "de", None, ""])) for n in range(80)]
    rows += [(100 + n, texts[0], "en") for n in range(60)]  # a hot text
    rows += [(200, None, "en"), (201, "", "de"), (202, None, None), (5, rows[5][1], "fr"), (None, texts[1], "en"), (None, None, "en"), (None, texts[1], None)]
    rows += [(300, texts[2], "en"), (300, texts[2], "en"), (301, "ÄÖ " * 3 + "Z", "de"), (302, " ".join(f"u{n}" for n in range(60_000)), "en")]
    return rows


LABELLED = [(n, n % 3 % 2, n % 4 // 3) for n in range(0, 130)] + [(9, 1, 1), (9, 0, None), (None, 1, 1), (300, 1, None), (999, 1, 1)]


def _audit(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, 2, "own", 3) for r in rows], SCHEMA)
    got = fa.audit(docs, spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r) for r in got.collect())


def test_against_filters_in_turn(spark):
    assert _audit(spark, _rows(), LABELLED) == brute(_rows(), LABELLED)


def test_a_full_sketch_only_costs_time(spark, monkeypatch):
    monkeypatch.setattr(fa, "SEGMENT", 64)
    monkeypatch.setattr(fa, "MOST_SEGMENTS", 1)
    assert _audit(spark, _rows(), LABELLED) == brute(_rows(), LABELLED)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "one", "en"), (1, "one", "en"), (1, "one", "en")]])
def test_few_rows(spark, rows):
    assert _audit(spark, rows, []) == brute(rows, [])


def test_prepass_clears_only_unique_texts(spark):
    rows = spark.range(20_000).selectExpr("xxhash64(id % 19000) AS a", "xxhash64(id % 19000, 7) AS b")
    bits = fa.repeated_cells(rows, 20_000)
    got = rows.distinct().toPandas()
    cells = fa.cells_of(got["a"].to_numpy(), got["b"].to_numpy(), len(bits) * 8 // fa.SEGMENT)
    perhaps = (bits[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).all(axis=1)
    again = {r.a for r in rows.groupBy("a").count().filter("count > 1").collect()}
    assert len(again) == 1000 and again <= set(got["a"][perhaps])
    assert perhaps.sum() < 1000 + 0.02 * 19_000
