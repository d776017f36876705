"""Byte-pair encoding by a minimal acyclic transducer of frequent words, exact merges for the rest.

The words of all documents are counted; the most frequent ones are merged once
and compiled into an acyclic automaton whose states share equal suffixes.  Each
transition carries the number of words that sort before those it leads to, so
a path adds up to the word's number, which points to its ids.  The automaton is
one file that Spark ships to every executor, where tasks map it into memory.
Words that it lacks are merged rank by rank.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import free_name, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words in the transducer at most; a parameter of ``lexicon``. Other words are merged exactly.
LEXICON_WORDS = 100_000
# Words whose ids a task remembers.
MEMO_WORDS = 500_000
# Bytes of text that a task tokenises before it looks words up together.
TEXT_BYTES = 4 << 20

# Characters whose class all Unicode versions in use agree on; others are split by the library.
_OLD = regex.compile(r"[^\x00-԰ -⁯₠-₿]")


def _known_classes(pattern: str, alphabet: str) -> re.Pattern | None:
    """The same pattern over an alphabet, its classes spelled out, for the standard engine.

    None if the pattern has more to it than letters, numbers and blanks in brackets.
    """
    plain = pattern
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        runs = regex.finditer(f"{name}+", alphabet)
        members = "".join(f"\\u{ord(c):04x}" for m in runs for c in m[0])
        plain = plain.replace(f"[{name}]", f"[{members}]").replace(f"[^{name}", f"[^{members}").replace(name, members)
    rest = regex.sub(r"\\u[0-9a-f]{4}", "", plain)
    return None if regex.search(r"[\\(){}?*.$&~-]", rest) else re.compile(plain)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Tokenizer:
    """The parts of a tokenizer file that words need: vocabulary, ranks, special tokens."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): n for n, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern["pattern"]["Regex"])
        old = "".join(c for c in map(chr, range(0x10000)) if not _OLD.match(c))
        self.ascii_words = _known_classes(pattern["pattern"]["Regex"], old[:128]) or self.words
        self.old_words = _known_classes(pattern["pattern"]["Regex"], old) or self.words
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.letters = _byte_letters()
        tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)]
        self._library = None

    def _split_rare(self, text: str) -> list[str]:
        if self._library is None:
            import tokenizers

            self._library = tokenizers.Tokenizer.from_file(self.path)
            self._bytes = {c: b for b, c in self.letters.items()}
        parts = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(self._bytes[c] for c in p).decode() for p, _ in parts]

    def split(self, text: str) -> list[str]:
        """Words and special tokens of a text, normalised."""
        if self.specials and "<|" in text:
            parts = self.specials.split(text)
            return [w for n, p in enumerate(parts) for w in ([p] if n % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        if _OLD.search(text):
            return self._split_rare(text)
        # One capital letter has a second small form at the end of words, which is not used here.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return (self.words if _OLD.search(text) else self.old_words).findall(text)

    def merge(self, word: str) -> list[int]:
        """Ids of a word: always the pair of the lowest rank, the leftmost first."""
        if word in self.special:
            return [self.special[word]]
        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += self.end
        if len(parts) > 48:
            return self._merge_long(parts)
        get, last = self.ranks.get, len(self.ranks)
        ranks = [get(p, last) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < last:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), last)
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), last)
        return [self.vocab[p] for p in parts]

    def _merge_long(self, parts: list) -> list[int]:
        """The same with a queue of pairs, for long words."""
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        queue: list[tuple] = []

        def offer(a: int) -> None:
            if a >= 0 and (b := after[a]) >= 0 and (rank := self.ranks.get((parts[a], parts[b]))) is not None:
                heapq.heappush(queue, (rank, a, parts[a], parts[b]))

        for n in range(len(parts)):
            offer(n)
        while queue:
            _, a, left, right = heapq.heappop(queue)
            b = after[a]
            if parts[a] != left or b < 0 or parts[b] != right:
                continue
            parts[a], parts[b] = left + right, None
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
            offer(before[a])
            offer(a)
        return [self.vocab[p] for p in parts if p is not None]


def _minimal_automaton(words: list[bytes]) -> tuple[list, list]:
    """States (final, transitions) of the smallest acyclic automaton of sorted words; the root is last.

    Words come in order, so when one leaves the path of its predecessor, the
    states behind the common part are finished and merge with equal ones.
    """
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    arcs: list[tuple] = []

    def finish(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(arcs)
            finals.append(node[0])
            arcs.append(key[1])
        return register[key]

    path: list[list] = [[False, []]]
    previous = b""
    for word in words:
        common = 0
        while common < min(len(word), len(previous)) and word[common] == previous[common]:
            common += 1
        while len(path) > common + 1:
            state = finish(path.pop())
            path[-1][1].append((previous[len(path) - 1], state))
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        previous = word
    while len(path) > 1:
        state = finish(path.pop())
        path[-1][1].append((previous[len(path) - 1], state))
    finish(path[0])
    return finals, arcs


def compile_lexicon(words: dict[str, list[int]]) -> bytes:
    """Automaton and ids as one block of int64 arrays behind a header of their lengths.

    Arrays: sorted keys ``state * 256 + byte``, next states, words sorting
    before, final marks, start of each word's ids (and the end), ids, root.
    """
    coded = sorted((w.encode(), ids) for w, ids in words.items())
    finals, arcs = _minimal_automaton([w for w, _ in coded])
    below = np.zeros(len(arcs), np.int64)
    keys, nexts, skips = [], [], []
    for state, out in enumerate(arcs):  # successors come first
        passed = int(finals[state])
        for byte, to in out:
            keys.append(state * 256 + byte)
            nexts.append(to)
            skips.append(passed)
            passed += int(below[to])
        below[state] = passed
    starts = np.cumsum([0, *(len(ids) for _, ids in coded)])
    flat = [i for _, ids in coded for i in ids]
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    columns = [np.array(c, np.int64) for c in (keys, nexts, skips)]
    parts = [c[order] for c in columns] + [np.array(c, np.int64) for c in (finals, starts, flat, [len(arcs) - 1])]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon mapped into memory; looks many words up at once."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int64, "r")
        ends = np.cumsum([7, *data[:7].tolist()])
        parts = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        self.keys, self.nexts, self.skips, self.finals, self.starts, self.ids, root = parts
        self.root = int(root[0])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 if it is not in the lexicon."""
        if not len(self.keys) or not words:
            return np.full(len(words), -1)
        lengths = np.array([len(w) for w in words])
        longest = min(int(lengths.max()), 64)
        table = np.zeros((len(words), longest), np.int64)
        flat = np.frombuffer(b"".join(w[:longest] for w in words), np.uint8)
        cut = np.minimum(lengths, longest)
        table[np.repeat(np.arange(len(words)), cut), np.arange(len(flat)) - np.repeat(np.cumsum(cut) - cut, cut)] = flat
        state = np.full(len(words), self.root)
        number = np.zeros(len(words), np.int64)
        for n in range(longest):
            live = np.flatnonzero((lengths > n) & (state >= 0))
            if not len(live):
                break
            key = state[live] * 256 + table[live, n]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[live] = np.where(hit, self.nexts[at], -1)
            number[live] += np.where(hit, self.skips[at], 0)
        found = (state >= 0) & (lengths <= longest)
        found[found] = self.finals[state[found]] == 1
        return np.where(found, number, -1)

    def ids_of(self, number: int) -> bytes:
        return self.ids[self.starts[number] : self.starts[number + 1]].astype("<u4").tobytes()


_loaded: dict[str, object] = {}


def _tokenizer(path: str) -> Tokenizer:
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def _lexicon(name: str) -> Lexicon:
    if name not in _loaded:
        _loaded[name] = Lexicon(SparkFiles.get(name))
    return _loaded[name]


def _count_words(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen = _tokenizer(path), Counter()

        def flush() -> pa.RecordBatch:
            words = [w for w in seen if w not in tokenizer.special]
            batch = pa.RecordBatch.from_arrays([pa.array(words), pa.array([seen[w] for w in words], pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                seen.update(tokenizer.split(text.as_py() or ""))
                if len(seen) > MEMO_WORDS:
                    yield flush()
        yield flush()

    return count


def lexicon(docs: DataFrame, path: str, text: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of all texts, ``words`` of them at most; the shipped file's name.

    Words as frequent as the first one beyond that number stay out, so that no
    task has to sort out ties.  Words of one byte and words beyond 64 bytes are
    left to the merges as well.
    """
    spark = docs.sparkSession
    small_batches(spark)
    counts = docs.select(F.col(text).cast("string")).mapInArrow(_count_words(path), "word STRING, n BIGINT")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.octet_length("word").between(2, 64))
    counts = materialize(counts, "word-counts").df
    # How many words have each count, from the highest down: at most ``words`` + 1 rows are needed.
    left, least = words, 0
    for row in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(words + 1).collect():
        left -= row.words
        if left < 0:
            least = row.n
            break
    top = counts.filter(F.col("n") > least).select("word")
    tokenizer = _tokenizer(path)
    return _ship(spark, compile_lexicon({r.word: tokenizer.merge(r.word) for r in top.toLocalIterator()}))


def _ship(spark: SparkSession, data: bytes) -> str:
    """Write to the shared folder and let Spark copy the file to each executor."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'lexicon')}/{name}")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(target)
    for at in range(0, len(data), 1 << 20):
        out.write(bytearray(data[at : at + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(system.makeQualified(target).toString())
    return name


class _Memo(dict):
    """Ids of words as little-endian bytes; new words are looked up together."""

    def __init__(self, tokenizer: Tokenizer, lexicon: Lexicon):
        super().__init__()
        self.tokenizer, self.lexicon = tokenizer, lexicon

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > MEMO_WORDS:
            self.clear()
            new = list(words)
        numbers = self.lexicon.numbers([w.encode() for w in new])
        for word, number in zip(new, numbers.tolist(), strict=True):
            if number >= 0 and word not in self.tokenizer.special:
                self[word] = self.lexicon.ids_of(number)
            else:
                self[word] = np.array(self.tokenizer.merge(word), "<u4").tobytes()


def _groups(texts: list[str], limit: int) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encode(path: str, name: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        memo = _Memo(tokenizer, _lexicon(name))
        for batch in batches:
            rest, texts = batch.columns[:-1], [t or "" for t in batch.columns[-1].to_pylist()]
            at = 0
            for group in _groups(texts, TEXT_BYTES):
                split = [tokenizer.split(t) for t in group]
                memo.learn(set().union(*split))
                ids = [b"".join(map(memo.__getitem__, words)) for words in split]
                columns = [c.slice(at, len(group)) for c in rest]
                at += len(group)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=batch.schema.names)

    return encode


def _decode(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(_tokenizer(path).tokens, pa.large_binary())
        blank = pa.scalar(b" ", pa.large_binary())
        for batch in batches:
            ids = [b or b"" for b in batch.columns[-1].to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]) // 4
            each = tokens.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
            texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), each), blank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts.cast(pa.binary())], names=batch.schema.names)

    return decode


def _last_mapped(df: DataFrame, source: str, target: str, kind: str, step) -> DataFrame:
    """Run ``step`` over the rows with ``source`` as last column, which becomes ``target``."""
    small_batches(df.sparkSession)
    kept = df.drop(target)
    mine = free_name(kept, f"{target}_work")
    ready = kept.withColumn(mine, F.col(source) if source in kept.columns else F.lit(None))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return ready.mapInArrow(step, f"{fields}, `{mine}` {kind}").withColumnRenamed(mine, target)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", words: int = LEXICON_WORDS) -> DataFrame:
    """All columns of ``docs`` plus ``ids``: the token ids as little-endian unsigned 32-bit numbers.

    Null and empty texts have no ids.  A column of the name ``ids`` is replaced.
    Texts are read as a whole, however long.
    """
    name = lexicon(docs, path, text, words)
    ready = docs.withColumn(text, F.col(text).cast("string"))
    return _last_mapped(ready, text, ids, "BINARY", _encode(path, name))


def decode(encoded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns plus ``decoded``: the tokens with a blank between, as UTF-8 bytes.

    The tokenizer file names no decoder, so tokens stay as the vocabulary has
    them.  Null ids are an empty text.
    """
    return _last_mapped(encoded, ids, decoded, "BINARY", _decode(path))
