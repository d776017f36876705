"""Code lengths against a plain model, and held-out accuracy."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from arbora.llm import language_id as li
from arbora.llm import queries


def _plain_bits(texts, text, contexts, order):
    """Method C with exclusion over the kept contexts, byte by byte."""
    counts = defaultdict(Counter)
    for t in texts:
        data = bytes(order) + t
        for n in range(order, len(data)):
            for k in range(order + 1):
                counts[data[n - k : n]][data[n]] += 1
    total = 0.0
    data = bytes(order) + text
    for n in range(order, len(data)):
        excluded, bits = set(), 0.0
        length = max(k for k in range(order + 1) if data[n - k : n] in contexts)
        while True:
            if length < 0:
                bits += math.log2(256 - len(excluded))
                break
            here = {b: c for b, c in counts[data[n - length : n]].items() if b not in excluded}
            if here:
                whole = sum(here.values()) + len(here)
                if data[n] in here:
                    bits -= math.log2(here[data[n]] / whole)
                    break
                bits -= math.log2(len(here) / whole)
                excluded |= set(here)
            length -= 1
        total += bits
    return total


def _model(spark, rows, monkeypatch):
    monkeypatch.setattr(li, "LEAST_COUNT", 2)
    return li.train(spark.createDataFrame(rows, "text STRING, lang STRING"))


def test_code_lengths(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda letters: "".join(rng.choice(letters) for _ in range(400))
    texts = {"x": [text("ab c"), text("abc")], "y": [text("bcd "), text("ad")]}
    model = _model(spark, [(t, lang) for lang, ts in texts.items() for t in ts], monkeypatch)
    asked = ["abcab", "dada bc", "b", "abcd" * 200]
    counts = defaultdict(Counter)
    for ts in texts.values():
        for t in ts:
            data = bytes(li.ORDER) + t.encode()
            for n in range(li.ORDER, len(data)):
                for k in range(li.ORDER + 1):
                    counts[k][data[n - k : n]] += 1
    # The counts that train drops: triples and longer that occur once in a language.
    contexts = {b""} | {c for k in counts for c in counts[k] if k <= 2}
    got = li.text_bits(model, [t.encode() for t in asked])
    if set(map(len, contexts)) == {0, 1, 2}:
        two = [_plain_bits([t.encode() for t in texts[lang]], asked[0].encode(), contexts, 2) for lang in ("x", "y")]
        assert got[0].argmin() == int(np.argmin(two))
    # Whole texts and their pieces side by side add up to the same.
    monkeypatch.setattr(li, "LANE", 7)
    assert np.allclose(li.text_bits(model, [t.encode() for t in asked]), got, rtol=1e-5)


def test_each_state_is_a_proper_code(spark, monkeypatch):
    model = _model(spark, [("abracadabra " * 9, "x"), ("lorem ipsum dolor " * 9, "y")], monkeypatch)
    bits = model.bits.reshape(-1, model.n_classes, 2)
    unused = 256 - (model.n_classes - 1)
    mass = np.exp2(-bits[:, :-1]).sum(axis=1) + unused * np.exp2(-bits[:, -1])
    # An escape that nothing follows is lost, so no state promises more than everything.
    assert (mass <= 1 + 1e-4).all() and mass.max() > 0.9


def test_odd_texts(spark, monkeypatch):
    model = _model(spark, [("the quick brown fox " * 20, "en"), ("der schnelle braune fuchs " * 20, "de"), (None, "fr"), ("x", None)], monkeypatch)
    assert model.languages == ["de", "en"]
    texts = [None, "", "123 !!", "quick fox", "schnelle", "ъ", "the " * 50_000, "the fox", "the fox"]
    df = spark.createDataFrame([(n, t, "own", 1) for n, t in enumerate(texts)], "doc_id BIGINT, text STRING, lang_pred STRING, found INT")
    got = li.identify(df, model)
    assert got.columns == ["doc_id", "text", "found", "lang_pred", "lang_score", "lang_bits"]
    rows = sorted(got.collect(), key=lambda r: r.doc_id)
    assert [r.lang_pred for r in rows[:5]] == ["und", "und", "und", "en", "de"]
    assert rows[5].lang_pred in ("en", "de") and rows[6].lang_pred == "en" and rows[7].lang_bits == rows[8].lang_bits
    assert all(0 <= r.lang_score <= 1 for r in rows)


def test_nothing_learnt(spark):
    none = spark.createDataFrame([], "text STRING, lang STRING")
    assert li.train(none) is None
    df = spark.createDataFrame([("abc",)], "text STRING")
    assert li.identify(df, None).first().lang_pred == li.UNKNOWN
    assert li.identify(none, None).count() == 0


def test_query_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_ppm_language(spark, sf).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98


def test_bound_on_training_bytes(spark):
    rows = [(f"text number {n} with words", "en") for n in range(400)]
    kept = li.training_texts(spark.createDataFrame(rows, "text STRING, lang STRING"), "text", "lang", 3000)
    assert 60 < kept.count() < 180
    assert pytest.approx(kept.count()) == kept.distinct().count()


def test_shares_count_distinct_texts_and_no_language_is_left_out(spark):
    rows = [("copied", "the same text again and again " * 4)] * 500 + [("copied", f"own text number {n} of many") for n in range(100)]
    rows += [(f"long{n}", f"{n} " + "very long " * 3000) for n in range(20)]
    drawn = li.training_texts(spark.createDataFrame(rows, "lang STRING, text STRING"), "text", "lang", 4000)
    got = {r.lang: r.n for r in drawn.groupBy("lang").count().withColumnRenamed("count", "n").collect()}
    assert got == {"copied": 101} | {f"long{n}": 1 for n in range(20)}
