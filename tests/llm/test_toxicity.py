"""The table of triples against the kernel itself, and held-out accuracy."""

import random

import numpy as np

from arbora.llm import queries, toxicity

LETTERS = {c: n + 1 for n, c in enumerate("abcdefghijklmnopqrstuvwxyz")}


def _kernel(a, b):
    def features(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + toxicity.DECAY ** (k - i - 2)
        return out

    fa, fb = features(a), features(b)
    return sum(v * fb.get(u, 0) for u, v in fa.items()) / np.sqrt(sum(v * v for v in fb.values()))


def test_triple_sums_are_the_kernel():
    words = ["idiot", "idxiot", "banana", "ab", "", "thequickbrownfox", "zzzzzz"]
    for landmark in ("idiot", "banana", "zzzz"):
        got = toxicity.triple_sums(words, LETTERS, toxicity._triples(landmark, LETTERS))
        assert np.allclose(got, [_kernel(w, landmark) for w in words], atol=1e-4)


def _rows(seed=1, n=900):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeiou" if k % 2 else "bdlmnrst") for k in range(rng.randrange(3, 9))) for _ in range(800)]
    insults = ["worthless", "pathetic", "clownish", "moronic"]
    out = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        bad = i % 4 == 0
        for _ in range(2 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        out.append((i, " ".join(words), int(bad)))
    return out, insults


def test_gapped_insults_and_odd_texts(spark):
    rows, insults = _rows()
    model = toxicity.train(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, toxic INT"))
    clean = rows[1][1]
    odd = [f"{clean} {insults[0][:4]}x{insults[0][4:]} {insults[1][:3]}-{insults[1][3:]}", f"{clean} {' '.join(insults[2])} {' '.join(insults[3])}"]
    texts = [*odd, clean, None, "", "x" * 100_000, clean + " \U0001f600 日本", clean]
    df = spark.createDataFrame([(n, t, "own", 1) for n, t in enumerate(texts)], "doc_id BIGINT, text STRING, toxicity STRING, found INT")
    got = toxicity.score(df, model)
    assert got.columns == ["doc_id", "text", "found", "toxicity"]
    scores = [r.toxicity for r in sorted(got.collect(), key=lambda r: r.doc_id)]
    assert all(s >= 0.5 for s in scores[:2]) and all(0 <= s < 0.5 for s in scores[2:])
    assert scores[2] == scores[-1]


def test_no_model(spark):
    none = spark.createDataFrame([], "doc_id BIGINT, text STRING, toxic INT")
    assert toxicity.train(none) is None
    assert toxicity.train(spark.createDataFrame([(1, "a b", 1), (2, None, 0)], "doc_id BIGINT, text STRING, toxic INT")) is None
    assert toxicity.score(none, None).count() == 0
    rows, _ = _rows(n=300)
    model = toxicity.train(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, toxic INT"))
    assert toxicity.score(none, model).count() == 0


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op4_string_kernel_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(got[i], t) for i, t in labels.items() if i in got and got[i].held_out and t is not None]
    assert sum(r.predicted == t for r, t in held) / len(held) > 0.9
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def _held_out(spark, sf):
    got = {r.doc_id: r for r in queries.op4_string_kernel_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[i].score, t) for i, t in labels.items() if i in got and got[i].held_out and t is not None]
    return [s for s, t in held if t], [s for s, t in held if not t], {r.score for r in got.values()}


def test_balanced_accuracy_on_held_out_labels(spark):
    toxic, clean, scores = _held_out(spark, "/root/testdata/sf0.1")
    recall, spared = sum(s >= 0.5 for s in toxic) / len(toxic), sum(s < 0.5 for s in clean) / len(clean)
    print("recall", recall, "clean texts left alone", spared)
    assert recall > 0.85 and spared > 0.97 and len(scores) > 1000


def test_few_labels_give_a_model(spark, sf):
    toxic, clean, scores = _held_out(spark, sf)
    assert len(scores) > 100
    assert sum(t > c for t in toxic for c in clean) > 0.8 * len(toxic) * len(clean)


def test_second_script(spark):
    """Letters beyond the frequent ones have a kernel as well."""
    rng = random.Random(4)
    letters = [chr(0x10D0 + n) for n in range(30)] + [chr(0x0561 + n) for n in range(30)] + list("abcdefghijklmnopqrstuvwxyz")
    plain = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(600)]
    insults = ["\u10d0\u10d1\u10d2\u10d3\u10d4\u10d5\u10d6", "\u0561\u0562\u0563\u0564\u0565\u0566\u0567"]
    rows = []
    for n in range(400):
        words = [rng.choice(plain) for _ in range(30)]
        if n % 4 == 0:
            words[rng.randrange(30)] = insults[n % 8 // 4]
        rows.append((n, " ".join(words), int(n % 4 == 0)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, toxic INT"))
    words = [insults[0][:3] + "x" + insults[0][3:], insults[1], *plain[:50]]
    strength = toxicity.triple_sums(words, model.letters, model.table) + model.bias
    assert strength[:2].min() > 0 and (strength[2:] > strength[0]).mean() < 0.1 and strength[1] > strength[2:].max()


def test_kernel_against_landmarks():
    landmarks, words = ["idiot", "banana", "zz"], ["idxiot", "anana", "", "q", "thequickbrownfox"]
    found = [toxicity._sparse(w, LETTERS) for w in landmarks]
    used = np.unique(np.concatenate([c for c, _ in found]))
    features = np.zeros((3, len(used) + 1), np.float32)
    for row, (code, weight) in zip(features, found, strict=True):
        row[np.searchsorted(used, code)] = weight
    got = toxicity._against(words, LETTERS, used, features)
    assert np.allclose(got[:, :2], [[_kernel(w, m) for m in landmarks[:2]] for w in words], atol=1e-4) and not got[:, 2].any()
