"""Encoding against the library itself, texts of every kind."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import bpe, queries

tokenizers = pytest.importorskip("tokenizers")
PATH = queries.vocabulary(queries.WORD_BPE)
ODD = [
    None,
    "",
    "   ",
    "Hello'S  world éà <|endoftext|>x ΑΣ 12<|startoftext|><|",
    "日本語テスト🎉🎉 ἈΣ Ᲊ \U0001f9ff",
    "a" * 3000 + "é" * 100,
    "'''s's 'Re  x\x1c\x85y",
    "İstanbul ẞ ﬁ é",
    "same words same words",
    "same words same words",
    "word " * 20_000,
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def _expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_query_matches_the_library(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op3_transducer_bpe(spark, sf).collect()}
    assert got == {d: _expected(library, t) for d, t in texts.items()}


@pytest.mark.parametrize("words", [0, 3, 1000])
def test_odd_texts(spark, library, words):
    rows = [(n, t, "kept", 7) for n, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids STRING, decoded INT")
    coded = bpe.decode(bpe.encode(docs, PATH, words=words), PATH)
    assert set(coded.columns) == {"doc_id", "text", "ids", "decoded"}
    for r in coded.collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(r.decoded).decode() == library.decode(ids, skip_special_tokens=False)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert bpe.decode(bpe.encode(docs, PATH), PATH).count() == 0


def test_automaton_shares_suffixes(tmp_path):
    words = {w: [n, n + 1] for n, w in enumerate(["walking", "talking", "walked", "talked", "walk", "talk"])}
    path = tmp_path / "lexicon.bin"
    path.write_bytes(bpe.compile_lexicon(words))
    lexicon = bpe.Lexicon(str(path))
    assert len(lexicon.finals) <= 11  # one tail for both stems
    asked = [*words, "wal", "walks", "", "x" * 200]
    found = lexicon.numbers([w.encode() for w in asked])
    for word, number in zip(asked, found.tolist(), strict=True):
        assert (number >= 0) == (word in words)
        if number >= 0:
            assert np.frombuffer(lexicon.ids_of(number), "<u4").tolist() == words[word]


def test_null_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, None)], "doc_id BIGINT, ids BINARY")
    assert bytes(bpe.decode(df, PATH).select(F.col("decoded")).first()[0]) == b""


def test_words_of_known_letters_are_found_by_the_standard_engine():
    """Both engines cut alike; the quick one is there for ASCII and for the letters all versions agree on."""
    tokenizer = bpe.Tokenizer(PATH)
    assert tokenizer.ascii_words is not tokenizer.words and tokenizer.old_words is not tokenizer.words
    alphabet = [c for c in map(chr, range(0x10000)) if not bpe._OLD.match(c)]
    for members, quick in ((alphabet[:128], tokenizer.ascii_words), (alphabet, tokenizer.old_words)):
        text = " ".join(a + b for a, b in zip(members, members[7:])) + " it's we'll 12 x\x1cy"
        assert quick.findall(text) == tokenizer.words.findall(text)
