"""Importance resampling against features counted one by one."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from arbora.llm import importance as im

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id BIGINT, text STRING, row INT, weight STRING, lines INT, key STRING"


def grams(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def buckets(text):
    return [zlib.crc32(g.encode()) % im.BUCKETS for g in grams(text)[1]]


def brute(rows, target, percent=5, least_words=20):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(buckets(text))
    for text in target:
        t.update(buckets(text))
    every, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (every + 10000)) / ((s[b] + 1) * (wanted + 10000)))) for b in range(10000)]
    out = []
    for key, text in rows:
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets(text))
        out.append([key, len(grams(text)[1]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((n for n, (_, text) in enumerate(rows) if grams(text)[0] >= least_words), key=lambda n: (-out[n][3], out[n][0] is None, out[n][0] or 0))
    for place, n in enumerate(able[: percent * len(able) // 100]):
        out[n][4] = place + 1
    return sorted(map(tuple, out), key=repr)


def _rows():
    rng = random.Random(8)
    words = [f"w{n}" for n in range(60)] + ["Größe", "ñandú", "日本語テキスト", "x" * 63, "y" * 64, "z" * 65, "q" * 400, "ÀÉ", "A1b2"]
    lines = [" ".join(rng.choices(words, k=rng.randrange(0, 9))) for _ in range(40)] + ["", "one", "two words", "...", "tab\there", "carriage\r"]
    rows = [(n, "\n".join(rng.choices(lines, k=rng.randrange(0, 30)))) for n in range(120)]
    rows += [(200, None), (201, ""), (202, "\n\n\n"), (203, "a\nb\nc\nd"), (204, "single"), (205, "-_-"), (206, " ".join(rng.choices(words, k=30_000)))]
    rows += [(300 + n, rows[3][1]) for n in range(60)] + [(None, rows[5][1]), (None, None), (7, rows[7][1]), (7, "other words " * 15)]
    rows.append((400, "\n".join(["the same line again"] * 3000)))
    return rows


def _df(spark, rows):
    return spark.createDataFrame([(k, t, 1, "own", 2, "x") for k, t in rows], SCHEMA)


def test_against_single_features(spark, monkeypatch):
    monkeypatch.setattr(im, "AT_ONCE", 5000)  # texts in several pieces
    rows, target = _rows(), ["w1 w2 w3 Größe", None, "", "two words\nÀÉ A1b2 w9", "w1 w2 w3"]
    bench = spark.createDataFrame([(n, t) for n, t in enumerate(target)], "item_id BIGINT, text STRING")
    got = im.score_documents(_df(spark, rows), bench)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == brute(rows, target)
    more = im.score_documents(_df(spark, rows), bench, percent=50)
    expected = brute(rows, target, percent=50)
    assert sorted((tuple(r)[:5] for r in more.collect()), key=repr) == expected
    kept = im.resample(_df(spark, rows), bench, percent=50)
    assert kept.columns == SCHEMA.replace(" BIGINT", "").replace(" STRING", "").replace(" INT", "").split(", ")
    drawn = {r[0] for r in expected if r[4]}
    assert {r.doc_id for r in kept.collect()} == drawn and kept.filter("doc_id = 7").count() < 3


@pytest.mark.parametrize("rows,target", [([], []), ([], ["a b c"]), ([(1, "a b c"), (2, None)], [])])
def test_empty_tables(spark, rows, target):
    bench = spark.createDataFrame([(n, t) for n, t in enumerate(target)], "item_id BIGINT, text STRING")
    got = im.score_documents(_df(spark, rows), bench)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == brute(rows, target)


def test_crc_of_composed_runs():
    text = "ab \n" + "k" * 200 + " ß 7 " + "m" * 70 + "\nend"
    data = np.frombuffer(text.encode(), np.uint8)
    words = im.words_of(data, np.array([len(data)]))
    crc = words.crcs(np.arange(len(words.start)))
    two, three = im._grams(crc, words.length)
    found = WORD.findall(text)
    assert crc.tolist() == [zlib.crc32(w.encode()) for w in found]
    assert two.tolist() == [zlib.crc32(" ".join(p).encode()) for p in zip(found, found[1:], strict=False)]
    assert three.tolist() == [zlib.crc32(" ".join(p).encode()) for p in zip(found, found[1:], found[2:], strict=False)]


def test_words_do_not_run_over_texts():
    texts = ["ab", "", "cd ef", "gh"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    words = im.words_of(data, np.cumsum([len(t) for t in texts]))
    assert words.text.tolist() == [0, 2, 2, 3] and words.length.tolist() == [2, 2, 2, 2]
