"""Top-k against all inner products."""

import math

import numpy as np
import pytest

from arbora.llm.topk import add_slices, top_k, _packed, _slices

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, score STRING"


def brute(rows, queries, k):
    clean = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    out = []
    for q, v in {i: v for i, v in queries if i is not None and clean(v)}.items():
        scored = [
            (-sum(a * b for a, b in zip(whole(v), whole(w), strict=True)), i is None, i)
            for i, w in rows
            if clean(w) and i != q and len(w) == len(v)
        ]
        out += [(q, n + 1, i, -s) for n, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(150)]
    rows += [(200 + i, rows[5][1]) for i in range(9)]  # ties
    rows += [(300, None), (301, [1.0] * 7 + [None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8)]
    rows += [(304, [0.5, 0.5]), (305, [0.25, 1.0]), (306, []), (None, rows[5][1]), (7, rows[7][1]), (310, [3000.0] + [0.0] * 7)]
    vectors = spark.createDataFrame([(i, v, "own") for i, v in rows], SCHEMA)
    asked = [r for r in rows if r[0] is None or r[0] % 10 == 0 or r[0] > 199]
    got = top_k(vectors, spark.createDataFrame([(i, v, "own") for i, v in asked], SCHEMA), 5, block_rows=block_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, asked, 5)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0], "x")], SCHEMA)
    assert top_k(none, none, 5).count() == 0
    assert top_k(one, one, 5).count() == 0


def test_too_large_for_64_bits(spark):
    rows = spark.createDataFrame([(1, [1e12]), (2, [1e12])], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        top_k(rows, rows, 1).collect()


def test_slices_add_up():
    rng = np.random.default_rng(1)
    values, weights = rng.integers(-300, 300, (130, 5)), np.array([3, -7, 0, 12, 1])
    slices, shift = _slices(values)
    total = add_slices(slices, shift, weights)
    bits = [np.unpackbits(t.view(np.uint8), bitorder="little")[:130].astype(int) for t in total]
    coarse = (values - values.min(axis=0)) >> shift
    coarse = np.where(weights < 0, 63 - coarse, coarse)
    assert (sum(b << n for n, b in enumerate(bits)) == coarse @ (abs(weights) << shift)).all()
    assert len(_packed(np.ones(130, np.uint8))) == 3
