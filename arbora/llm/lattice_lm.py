"""Language model over a lattice of subword segmentations.

A text is a sequence of words and an end.  A word is either drawn whole from the
counts of the training words, or spelled with pieces of an existing subword
vocabulary; its probability is the sum over all ways, computed by a forward
recursion in log space.  Spelling starts with a word-initial piece, goes on
with inner pieces and stops with a fixed probability; all segmentations count.
The vocabulary's own scores are where the piece probabilities start; expected
piece counts over the distinct training words (two rounds of forward-backward)
fit them to the corpus.

The work is done once per distinct word: texts are read once and turned into
postings (word, texts that hold it), block by block of texts.  What a word is
worth goes back to its blocks, where each text's sum is made.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import gathered, small_batches, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rounds of fitting, discount of word counts, bytes of text and rows in a block of postings.
ROUNDS, DISCOUNT = 2, 0.5
BLOCK_BYTES, BLOCK_TEXTS = 16 << 20, 30_000
# Words up to this many bytes are worked on together, longer ones one by one.
TOGETHER = 48
WORDS_AT_ONCE = 4096
STORED = "block BIGINT, row INT, held_out BOOLEAN, n_tokens BIGINT, number INT, word BINARY, trained BIGINT, postings BINARY"


@dataclass
class Pieces:
    """Piece strings as bytes; word-initial ones begin with a blank."""

    text: list[bytes]
    initial: np.ndarray
    log_p: np.ndarray
    log_stop: float = float(np.log(0.4))
    table: tuple[np.ndarray, np.ndarray, int] | None = None  # made once for a vocabulary

    def __post_init__(self):
        self.longest = max(map(len, self.text))
        if self.table is None:
            spelled = [t[1:] if i else t for t, i in zip(self.text, self.initial, strict=True)]
            codes = np.array([_code(t, bool(i)) for t, i in zip(spelled, self.initial, strict=True)], np.uint64)
            self.table = _hash_table(codes)
        self.slots, self.at, self.probes = self.table

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the codes that are pieces, and their pieces."""
        slot = (codes * MIX >> SHIFT).astype(np.int64)
        held = self.slots[slot]
        # most slots are empty
        met = np.flatnonzero(held)
        hit = held[met] == codes[met]
        rows, left = met[hit], met[~hit]
        found = [(rows, self.at[slot[rows]])]
        for probe in range(1, self.probes):
            if not len(left):
                break
            slot_ = slot[left] + probe & SLOTS - 1
            held = self.slots[slot_]
            hit = held == codes[left]
            found.append((left[hit], self.at[slot_[hit]]))
            left = left[~hit & (held != 0)]
        if len(found) == 1:
            return found[0]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


BASE = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 1 << 19
MIX, SHIFT = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(64 - 19)


def _hash_table(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Slots filled by linear probing, the code in each, and the longest probe."""
    slots, at, probes = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), 1
    for n, (code, slot) in enumerate(zip(codes, (codes * MIX >> SHIFT).tolist(), strict=True)):
        probe = 1
        while slots[slot]:
            slot, probe = slot + 1 & SLOTS - 1, probe + 1
        slots[slot], at[slot], probes = code, n, max(probes, probe)
    return slots, at, probes

MARK = 0xD1B54A32D192ED03


def _code(text: bytes, initial: bool) -> int:
    """Rolling hash of the bytes, apart for word-initial pieces and for lengths."""
    h = 0
    for b in text:
        h = (h * int(BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h ^ ((len(text) * 2 + initial) * MARK & 0xFFFFFFFFFFFFFFFF)


def vocabulary_pieces(path: str) -> Pieces:
    """Pieces of a vocabulary file that can occur in lower-case words, weighted by its scores.

    The file scores a piece by its rank; a piece starts with a weight of one over its rank.
    Every byte is a piece, initial and inner, so that any word has a segmentation.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    text, initial, weight = [], [], []
    lowest = min(model.get_score(i) for i in range(model.get_piece_size()) if model.get_score(i) > -1e8)
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.get_score(i) <= -1e8:
            continue
        piece = model.id_to_piece(i)
        body = piece.removeprefix("▁")
        if body and "▁" not in body and not any("A" <= c <= "Z" for c in body):
            text.append((b" " if piece != body else b"") + body.encode())
            initial.append(piece != body)
            weight.append(1.0 / (2.0 - model.get_score(i)))
    known = set(text)
    for b in range(256):
        for start in (False, True):
            t = (b" " if start else b"") + bytes([b])
            if t not in known and b not in b"\x20\x09\x0a\x0b\x0c\x0d":
                text.append(t)
                initial.append(start)
                weight.append(1.0 / (2.0 - lowest))
    mark = np.array(initial)
    w = np.array(weight)
    for kind in (False, True):
        w[mark == kind] /= w[mark == kind].sum()
    return Pieces(text, mark, np.log(w))


def _matrix(words: list[bytes]) -> np.ndarray:
    width = len(words[0])
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), width)


def _arcs(x: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, rows, pieces) of all pieces in words of equal length, by end and start."""
    n, width = x.shape
    powers = np.ones(width + 1, np.uint64)
    np.multiply.accumulate(np.full(width, BASE), out=powers[1:])
    hashes = np.zeros((width + 1, n), np.uint64)
    for i in range(width):
        hashes[i + 1] = hashes[i] * BASE + x[:, i] + np.uint64(1)
    for end in range(1, width + 1):
        for start in range(max(0, end - pieces.longest), end):
            mark = np.uint64(((end - start) * 2 + (start == 0)) * MARK & 0xFFFFFFFFFFFFFFFF)
            rows, at = pieces.find(hashes[end] - hashes[start] * powers[end - start : end - start + 1] ^ mark)
            if len(rows):
                yield start, end, rows, at


def _forward(x: np.ndarray, pieces: Pieces, arcs=None) -> np.ndarray:
    """Log probability of every prefix, (length + 1, words), without the stop."""
    n, width = x.shape
    alpha = np.full((width + 1, n), -np.inf)
    alpha[0] = 0.0
    go = np.log1p(-np.exp(pieces.log_stop))
    for start, end, rows, at in _arcs(x, pieces) if arcs is None else arcs:
        step = alpha[start, rows] + pieces.log_p[at] + (go if start else 0.0)
        alpha[end, rows] = np.logaddexp(alpha[end, rows], step)
    return alpha


def spell(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """Log probability of each word over all its segmentations."""
    out = np.zeros(len(words))
    for rows, same in _by_length(words):
        out[rows] = _forward(_matrix(same), pieces)[-1] + pieces.log_stop
    return out


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        size = lengths[order[start]]
        end = min(int(np.searchsorted(lengths[order], size, side="right")), start + (WORDS_AT_ONCE if size <= TOGETHER else 1))
        rows = order[start:end]
        yield rows, [words[r] for r in rows]
        start = end


def expected(words: list[bytes], weights: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, float]:
    """Expected uses of each piece over the words' segmentations, and expected stops per word."""
    uses = np.zeros(len(pieces.text))
    go = np.log1p(-np.exp(pieces.log_stop))
    for rows, same in _by_length(words):
        x = _matrix(same)
        arcs = list(_arcs(x, pieces))
        alpha = _forward(x, pieces, arcs)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = pieces.log_stop
        whole = alpha[-1] + pieces.log_stop
        for start, end, at_rows, at in reversed(arcs):
            step = pieces.log_p[at] + (go if start else 0.0)
            beta[start, at_rows] = np.logaddexp(beta[start, at_rows], step + beta[end, at_rows])
            share = np.exp(alpha[start, at_rows] + step + beta[end, at_rows] - whole[at_rows])
            np.add.at(uses, at, share * weights[rows][at_rows])
    return uses, float(weights.sum())


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text, a row per distinct word of a block of texts, and one with the block's postings.

    Columns in: held_out, text as bytes, then those of the text rows to carry on.
    """
    number = TaskContext.get().partitionId() << 24
    held: list[bytes] = []
    fold: list[bool] = []
    carried: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for n, (out, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            held.append(text)
            fold.append(out)
            carried.append(batch.slice(n, 1))
            size += len(text)
            if size >= BLOCK_BYTES or len(held) >= BLOCK_TEXTS:
                yield from _block(number, held, fold, carried)
                number, held, fold, carried, size = number + 1, [], [], [], 0
    if held:
        yield from _block(number, held, fold, carried)


def _block(number: int, held: list[bytes], fold: list[bool], carried: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index: dict[bytes, int] = {}
    ids, lengths = [], []
    for text in held:
        words = text.lower().split()
        lengths.append(len(words))
        ids.append(np.array([index.setdefault(w, len(index)) for w in words], np.int64))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(held)), lengths)
    pairs, times = np.unique(flat * len(held) + rows, return_counts=True)
    word, row = pairs // len(held), pairs % len(held)
    trained = np.bincount(word, weights=np.where(np.array(fold)[row], 0, times), minlength=len(index)).astype(np.int64)
    ends = np.searchsorted(word, np.arange(len(index) + 1)).astype("<u4")
    small = np.uint16 if times.max(initial=0) < 1 << 16 else np.uint32
    postings = ends.tobytes() + row.astype(np.uint16).tobytes() + times.astype(small).tobytes()
    own = pa.Table.from_batches(carried).select(carried[0].schema.names[2:]).combine_chunks()
    tokens = pa.array([n + 1 for n in lengths], pa.int64())
    yield _stored(number, len(held), own, row=pa.array(range(len(held)), pa.int32()), held_out=pa.array(fold), n_tokens=tokens)
    words = list(index)
    for at in range(0, len(words), 50_000):
        part = slice(at, at + 50_000)
        numbers = pa.array(np.arange(at, at + len(words[part]), dtype=np.int32))
        yield _stored(number, len(words[part]), own, number=numbers, word=pa.array(words[part], pa.binary()), trained=pa.array(trained[part]))
    yield _stored(number, 1, own, number=pa.array([len(words)], pa.int32()), postings=pa.array([postings], pa.binary()))


def _stored(block: int, n: int, own: pa.Table, **given: pa.Array) -> pa.RecordBatch:
    """One batch of the stored table; columns not given are null."""
    kinds = {"row": pa.int32(), "held_out": pa.bool_(), "n_tokens": pa.int64()}
    kinds |= {"number": pa.int32(), "word": pa.binary(), "trained": pa.int64(), "postings": pa.binary()}
    columns = {"block": pa.array(np.full(n, block, np.int64))} | {k: given.get(k, pa.nulls(n, t)) for k, t in kinds.items()}
    for name in own.column_names:
        whole = own.column(name)
        columns[f"_{name}"] = (whole.chunk(0) if whole.num_chunks else pa.nulls(n, whole.type)) if "row" in given else pa.nulls(n, whole.type)
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _fit(shared: Broadcast):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(**shared.value)
        uses, total = np.zeros(len(pieces.text)), 0.0
        for batch in gathered(batches, 2 * WORDS_AT_ONCE):
            words = batch.column(0).to_pylist()
            if words:
                more, n = expected(words, np.ones(len(words)), pieces)
                uses, total = uses + more, total + n
        if total:
            at = np.flatnonzero(uses)
            columns = [pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(uses[at], total))]
            yield pa.RecordBatch.from_arrays(columns, names=["piece", "uses"])

    return fit


def fit_pieces(words: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> Pieces:
    """Fit piece probabilities to the distinct ``word`` values; the driver gets one row per piece."""
    context = words.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(_plain(pieces))
        uses = words.select("word").mapInArrow(_fit(shared), "piece INT, uses DOUBLE").groupBy("piece").agg(F.sum("uses").alias("uses"))
        found = {r.piece: r.uses for r in uses.collect()}
        total = found.pop(-1, 0.0)
        if not total:
            return pieces
        counts = np.full(len(pieces.text), 0.1)
        for piece, n in found.items():
            counts[piece] += n
        inner = counts[~pieces.initial].sum()
        log_p = np.log(counts)
        for kind in (False, True):
            log_p[pieces.initial == kind] -= np.log(counts[pieces.initial == kind].sum())
        pieces = Pieces(pieces.text, pieces.initial, log_p, float(np.log(total / (total + inner))), pieces.table)
    return pieces


def _plain(pieces: Pieces) -> dict:
    return {"text": pieces.text, "initial": pieces.initial, "log_p": pieces.log_p, "log_stop": pieces.log_stop, "table": pieces.table}


def _spelled(shared: Broadcast, n_train: int, n_words: int):
    """The log probability of each word of each block; words come in order, so a batch has each word once."""

    def spell_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(**shared.value)
        for batch in gathered(batches, 4 * WORDS_AT_ONCE):
            words = batch.column("word").to_pylist()
            index = {w: n for n, w in enumerate(dict.fromkeys(words))}
            spelled = spell(list(index), pieces)[[index[w] for w in words]]
            counts = pc.fill_null(batch.column("count"), 0)
            log = _word_log(counts.to_numpy().astype(float), spelled, n_train, n_words)
            columns = [batch.column("block"), batch.column("number"), counts, pa.array(log)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "number", "count", "log"])

    return spell_words


def _add_up(total: int):
    """Sums per text: a block's words in order of their numbers, then its postings."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[np.ndarray] = []
        logs: list[np.ndarray] = []
        for batch in batches:
            ends = np.flatnonzero(batch.column("postings").is_valid().to_numpy(zero_copy_only=False))
            start = 0
            for end in [*ends.tolist(), batch.num_rows]:
                part = batch.slice(start, end - start)
                counts.append(part.column("count").to_numpy(zero_copy_only=False).astype(float))
                logs.append(part.column("log").to_numpy(zero_copy_only=False))
                if end < batch.num_rows:
                    yield _sums(batch.column("block")[end].as_py(), batch.column("postings")[end].as_py(), np.concatenate(counts), np.concatenate(logs), total)
                    counts, logs = [], []
                start = end + 1

    return add_up


def _sums(block: int, postings: bytes, counts: np.ndarray, logs: np.ndarray, total: int) -> pa.RecordBatch:
    ends = np.frombuffer(postings, "<u4", len(counts) + 1)
    n, at = int(ends[-1]), 4 * len(ends)
    row = np.frombuffer(postings, np.uint16, n, at)
    at += 2 * n
    times = np.frombuffer(postings, np.uint16 if len(postings) - at == 2 * n else np.uint32, n, at)
    figures = (counts > 0, np.log10((counts + 1) / total), logs / np.log(10))
    uses = np.diff(ends.astype(np.int64))
    sums = [np.bincount(row, weights=np.repeat(f, uses) * times).astype(float) for f in figures]
    columns = [pa.array(np.full(len(sums[0]), block, np.int64)), pa.array(np.arange(len(sums[0]), dtype=np.int32)), *map(pa.array, sums)]
    return pa.RecordBatch.from_arrays(columns, names=["block", "row", "known", "base", "score"])


def _word_log(counts: np.ndarray, spelled: np.ndarray, n_train: int, n_words: int) -> np.ndarray:
    """Log probability of words: discounted counts, and the discounted rest spread by spelling.

    Before anything is learnt all words are spelled.
    """
    n = max(n_train, 1)
    rest = DISCOUNT * n_words / n if n_train else 1.0
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(np.maximum(counts - DISCOUNT, 0.0) / n), np.log(rest) + spelled)


def score_texts(docs: DataFrame, vocabulary: str, held_out: Column, text: str = "text", rounds: int = ROUNDS, keep: list[str] | None = None) -> DataFrame:
    """All columns, or those to ``keep``, plus ``held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Null texts are empty; an empty text is its end alone.  Columns of these
    names are replaced.  Texts are read whole; a word may be as long as its text.
    Logarithms are decimal; ``score`` is that of the text's probability.
    """
    small_batches(docs.sparkSession)
    ours = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    mark = F.coalesce(held_out, F.lit(False))
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ours or (keep is not None and c not in keep)])
    ready = docs.select(mark.alias("held_out"), utf8(text).alias("text"), *[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(kept.columns)])
    carried = "".join(f", _c{n} {f.dataType.simpleString()}" for n, f in enumerate(kept.schema.fields))
    stored = materialize(ready.mapInArrow(_postings, STORED + carried), "postings").df
    texts, words = stored.filter("row IS NOT NULL"), stored.filter("word IS NOT NULL")
    counts = words.groupBy("word").agg(F.sum("trained").alias("count")).filter("count > 0")
    counts = materialize(counts, "counts").df
    n_words, n_inner = counts.agg(F.count(F.lit(1)), F.sum("count")).first()
    n_ends = texts.filter(~F.col("held_out")).count()
    n_train, n_words = (n_inner or 0) + n_ends, n_words + (n_ends > 0)
    pieces = fit_pieces(counts, vocabulary_pieces(vocabulary), rounds)
    shared = docs.sparkSession.sparkContext.broadcast(_plain(pieces))
    met = words.select("block", "number", "word").join(counts, "word", "left").select("word", "block", "number", "count")
    figures = met.mapInArrow(_spelled(shared, n_train, n_words), "block BIGINT, number INT, count BIGINT, log DOUBLE")
    postings = stored.filter("postings IS NOT NULL").select("block", "number", "postings")
    blocks = figures.unionByName(postings, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "number")
    sums = blocks.mapInArrow(_add_up(n_train + n_words + 1), "block BIGINT, row INT, known DOUBLE, base DOUBLE, score DOUBLE")
    n = max(n_train, 1)
    whole = max(n_ends - DISCOUNT, 0.0) / n
    # An end that was never learnt has the share that no word can have.
    end_base = float(np.log10((n_ends + 1) / (n_train + n_words + 1)))
    end_score = float(np.log10(whole if n_ends else 1.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return texts.join(sums, ["block", "row"], "left").select(
        *[F.col(f"_c{n}").alias(c) for n, c in enumerate(kept.columns)],
        "held_out",
        "n_tokens",
        (zero("known").cast("bigint") + F.lit(int(n_ends > 0))).alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        (zero("base") + end_base).alias("base_score"),
        (zero("score") + end_score).alias("score"),
    )
