"""Classes against all pairs of the whole texts."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from arbora.llm import near_dedup as nd

SCHEMA = "doc_id BIGINT, text STRING, class_id STRING, id INT, label STRING"


def _texts(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for n in range(12):
        base = [rng.choice(vocabulary) for _ in range(150)]
        texts.append(base)
        for edits in (1, 1, 2, 3, 9):
            other = list(base)
            for _ in range(edits):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append(other)
        texts.append(passage + [rng.choice(vocabulary) for _ in range(70)])
    return [" ".join(t) for t in texts]


def _brute(rows, least=nd.SIMILARITY):
    texts = list(dict.fromkeys(t for _, t in rows))
    known = [t for t in texts if t is not None]
    df = Counter(w for t in known for w in set(t.lower().split()))
    top = float(np.log(1 / nd.COMMON)) + 1
    idf = {w: min(top, float(np.log(len(known) / n)) + 1) for w, n in df.items() if n >= max(2.0, nd.COMMON * len(known))}
    shingler = nd.Shingler(idf, top)
    sets = {t: shingler(t) for t in known}
    group = {t: {t} for t in texts}
    for a, b in itertools.combinations(known, 2):
        if len(sets[a][0]) and len(sets[b][0]) and nd.similarity(sets[a], sets[b]) >= least and group[a] is not group[b]:
            group[a] |= group[b]
            for t in group[b]:
                group[t] = group[a]
    first = lambda t: min((i for i, u in rows if u in group[t] and i is not None), default=None)
    return sorted(((i, t, first(t)) for i, t in rows), key=repr)


def test_against_all_pairs(spark):
    rows = list(enumerate(_texts()))
    rows += [(1000 + n, rows[3][1]) for n in range(40)]  # a large group of copies
    rows += [(2000, None), (2001, None), (2002, ""), (2003, "  "), (2004, ""), (2005, "one two"), (2006, "One  two"), (2006, "One  two")]
    rows += [(None, rows[7][1]), (None, "alone among all the others here"), (2007, " ".join(["same"] * 5000))]
    df = spark.createDataFrame([(*r, "own", 1, "x") for r in rows], SCHEMA)
    got = nd.near_duplicates(df)
    assert got.columns == ["doc_id", "text", "id", "label", "class_id"]
    expected = _brute(rows)
    assert sorted(((r.doc_id, r.text, r.class_id) for r in got.collect()), key=repr) == expected
    kept = nd.one_of_each(df)
    assert kept.columns == df.columns
    classes = Counter(c for _, _, c in expected if c is not None)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(classes)
    assert sum(i is None for i in ids) == 1


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert nd.near_duplicates(df).count() == 0 and nd.one_of_each(df).count() == 0


def test_draws_collide_with_the_weighted_similarity():
    rng = np.random.default_rng(2)
    codes = rng.integers(1, 1 << 62, 3000).astype(np.uint64)
    a, b = (codes[:2200], rng.uniform(1, 5, 2200).astype(np.float32)), (codes[600:], rng.uniform(1, 5, 2400).astype(np.float32))
    rates = []
    for n in range(12):
        salt = np.uint64(n * 7919)
        sets = [(nd._mixed(c + salt), w) for c, w in (a, b)]
        owner = np.repeat([0, 1], [len(a[0]), len(b[0])])
        drawn = nd.draws(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), owner, 2, nd._quantiles())
        rates.append((drawn[0] == drawn[1]).mean())
    assert abs(np.mean(rates) - nd.similarity((np.sort(a[0]), a[1][np.argsort(a[0])]), (np.sort(b[0]), b[1][np.argsort(b[0])]))) < 0.05


def test_one_text_differs_from_itself_in_nothing():
    s = nd.Shingler({}, 1.0)("a b c d e f a b c d e")
    assert nd.similarity(s, s) == pytest.approx(1.0)
    assert s[1].sum() == pytest.approx(7.0)


def test_base_with_many_edits(spark):
    """Edits are similar to their base and not to each other."""
    rng = random.Random(11)
    vocabulary = [f"v{n}" for n in range(4000)]
    texts = []
    for _ in range(2):
        base = [rng.choice(vocabulary) for _ in range(300)]
        texts.append(base)
        for n in range(250):
            other = list(base)
            for at in rng.sample(range(0, 300, 5), 4 + n % 2):
                other[at] = rng.choice(vocabulary)
            texts.append(other)
    rng.shuffle(texts)
    rows = list(enumerate(" ".join(t) for t in texts))
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    assert sorted(((r.doc_id, r.text, r.class_id) for r in got.collect()), key=repr) == _brute(rows)


def test_all_pairs_of_a_bucket_meet(spark, monkeypatch):
    """Blocks of few texts: chains of pairs without a common leader, groups beside the leader's."""
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 2)
    monkeypatch.setattr(nd, "COLUMNS", 50)
    test_against_all_pairs(spark)


def test_blocks_agree_with_single_pairs():
    rng = random.Random(3)
    words = [f"u{n}" for n in range(30)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(20)]
    texts += [t + " " + t for t in texts[:8]] + [" ".join(["same"] * n) for n in (1, 3, 7, 8, 40)] + texts[:3]
    shingler = nd.Shingler({w: 1 + n / 7 for n, w in enumerate(words)}, 6.0)
    sets = [shingler(t) for t in texts]
    codes, weights = np.concatenate([c for c, _ in sets]), np.concatenate([w for _, w in sets])
    owner = np.repeat(np.arange(len(sets)), [len(c) for c, _ in sets])
    shared = nd._shared(codes, weights, owner, len(sets), 11)
    whole = np.array([w.astype(float).sum() for _, w in sets])
    for i, j in itertools.product(range(11), range(len(sets))):
        if i != j:
            assert shared[i, j] / (whole[i] + whole[j] - shared[i, j]) == pytest.approx(nd.similarity(sets[i], sets[j]), abs=1e-9)


def test_a_forest_connects_what_all_links_connect():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 40, 90)
    links = rng.random((50, 90)) < 0.004
    group = {int(x): {int(x)} for x in labels}
    for i, j in zip(*np.nonzero(links), strict=True):
        a, b = group[int(labels[i])], group[int(labels[j])]
        if a is not b:
            a |= b
            for x in b:
                group[x] = a
    forest = nd._forest(links & (labels[:50, None] != labels[None, :]), labels)
    classes = {frozenset(g) for g in group.values()}
    assert len(forest) == len(group) - len(classes)
    assert all(group[a] is group[b] for a, b in forest)
