"""Vantage-point trees against all distances."""

import math

import numpy as np
import pytest

from arbora.llm.vp_trees import FACTOR, build, nearest

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, score STRING, part INT"


def brute(rows, queries, k):
    clean = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    exact = lambda v: [float(np.float32(x)) for x in v]
    out = []
    smallest = {}
    for q, v in queries:
        if q is not None and clean(v):
            smallest[q] = min(smallest.get(q, exact(v)), exact(v))
    for q, v in smallest.items():
        scored = []
        for i, w in rows:
            if clean(w) and i != q and len(w) == len(v):
                total = 0.0
                for a, b in zip(v, exact(w), strict=True):
                    total += (a - b) * (a - b)
                scored.append((math.sqrt(total), i is None, i))
        out += [(q, n + 1, i, s) for n, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def _rows(rng):
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(150)]
    rows += [(200 + i, rows[5][1]) for i in range(19)]  # ties
    rows += [(300, None), (301, [1.0] * 7 + [None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (308, [0.0] * 8)]
    rows += [(304, [0.5, 0.5]), (305, [0.25, 1.0]), (306, []), (None, rows[5][1]), (None, rows[9][1]), (7, rows[7][1]), (310, [3000.0] + [0.0] * 7)]
    return rows


@pytest.mark.parametrize("shard_rows,leaf_rows", [(40, 4), (8192, 16)])
def test_factor_one_is_exact(spark, shard_rows, leaf_rows):
    rows = _rows(np.random.default_rng(3))
    asked = [r for r in rows if r[0] is None or r[0] % 10 == 0 or r[0] > 199] + [(20, rows[3][1])]
    frame = lambda some: spark.createDataFrame([(i, v, "own", 1) for i, v in some], SCHEMA)
    got = nearest(frame(rows), frame(asked), 5, factor=1.0, shard_rows=shard_rows, leaf_rows=leaf_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, asked, 5)


def test_fewer_rows_than_asked_for(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    assert [tuple(r) for r in nearest(df, df.filter("vec_id = 0"), 10).collect()] == [(0, 1, 1, math.sqrt(2))]
    assert nearest(df.limit(0), df, 10).count() == 0 and nearest(df, df.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        nearest(df, df, 10, factor=0.5)


def test_tree_holds_every_row_once():
    points = np.random.default_rng(5).normal(size=(1000, 6))
    order, nodes = build(points, 10)
    assert sorted(order.tolist()) == list(range(1000))
    leaves = nodes[nodes["left"] < 0]
    assert leaves["hi"].max() == 1000 and (leaves["hi"] - leaves["lo"]).max() <= 10
    for node in nodes[nodes["left"] >= 0]:
        away = np.linalg.norm(points[order] - points[order[node["lo"]]], axis=1)
        for n, child in enumerate((nodes[node["left"]], nodes[node["right"]])):
            part = away[child["lo"] : child["hi"]]
            assert np.allclose([part.min(), part.max()], [node["least"][n], node["most"][n]])


def test_recall_at_the_production_factor(spark):
    from arbora.llm.queries import op11_vantage_point_neighbours as run

    folder = "/root/testdata/sf0.1"
    found = run(spark, folder).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    wanted = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert len(found) == len(wanted)
    near = {(q, i): s for q, _, i, s in wanted}
    hits = sum((r.query_id, r.vec_id) in near for r in found)
    print("recall", hits / len(wanted))
    assert FACTOR > 1 and hits >= 0.95 * len(wanted)
    assert all(near.get((r.query_id, r.vec_id), r.score) == pytest.approx(r.score, abs=1e-12) for r in found)
    for q in {r.query_id for r in found}:
        mine = sorted((r.rank, r.score) for r in found if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[1] for m in mine] == sorted(m[1] for m in mine)
