"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order: contexts up to
``ORDER`` bytes with the counts of the bytes that followed them.  A byte's code
length follows method C with exclusion: in a context with ``t`` counts and ``d``
distinct bytes a seen byte costs ``-log2(c / (t + d))``, an unseen one first the
escape ``-log2(d / (t + d))`` and then its code in the context one byte shorter,
where the bytes of the longer context no longer count.  Below order 0 all bytes
not seen at all are equally likely.  The counts are frozen after training, so
the code length of a (context, byte) pair is a constant: all trees together
become one table over their contexts, and a text's code lengths are sums along
a walk through it.  The shortest code wins.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_name, small_batches, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 4
# Bytes of text per language that training uses at most (whole texts, by hash order); a documented bound.
TRAIN_BYTES = 2_000_000
# Longer contexts are kept if they occurred this often, and at most so many in all; shorter ones come first.
LEAST_COUNT = 32
MOST_CONTEXTS = 24_000
# Texts are walked in pieces of this many bytes, side by side.
LANE = 256
BATCH_BYTES = 4 << 20
UNKNOWN = "und"


@dataclass
class Model:
    """``step[state * classes + class]``: next state; ``bits[...]``: code lengths per language."""

    languages: list[str]
    classes: np.ndarray
    n_classes: int
    step: np.ndarray
    bits: np.ndarray


def training_texts(docs: DataFrame, text: str, lang: str, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """``lang, text``: distinct labelled texts in the order of their hash, up to ``most_bytes`` per language.

    The bound is kept by hash ranges: each language takes the texts whose hash
    is below its share of ``most_bytes``, so nothing is sorted or collected.
    Shares count distinct texts, and a language's text of the smallest hash is
    always taken, whatever its length.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    place = F.shiftrightunsigned(F.xxhash64("text"), 11).cast("double") / float(1 << 53)
    # Two hashes and the length stand for a text.
    once = rows.select("lang", place.alias("place"), F.xxhash64(F.lit(1), "text").alias("print"), F.octet_length("text").alias("size")).distinct()
    sizes = once.groupBy("lang").agg(F.sum("size").alias("bytes"), F.min("place").alias("least"))
    share = F.least(F.lit(1.0), F.lit(float(most_bytes)) / F.col("bytes"))
    limits = {r.lang: (r.share, r.least) for r in sizes.select("lang", share.alias("share"), "least").collect()}
    if not limits:
        return rows.limit(0)
    limit, least = (F.element_at(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v[n]))]), F.col("lang")) for n in (0, 1))
    return rows.filter((place < limit) | (place == least)).dropDuplicates(["lang", "text"])


def _count(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[bytes]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(bytes(order) + text)
        for lang, parts in texts.items():
            data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
            starts = np.cumsum([0, *map(len, parts)])[:-1]
            for k in range(order + 1):
                keep = np.ones(len(data), bool)
                for n in range(order):  # the zero bytes before a text are context only
                    keep[starts + n] = False
                code = np.zeros(len(data), np.int64)
                for n in range(k, -1, -1):
                    code = code * 256 + np.roll(data, n)
                codes, counts = np.unique(code[keep], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(codes)),
                        pa.array(np.full(len(codes), k), pa.int32()),
                        pa.array(codes),
                        pa.array(counts.astype(np.int64)),
                    ],
                    names=["lang", "k", "code", "n"],
                )

    return count


def train(docs: DataFrame, text: str = "text", lang: str = "lang", most_bytes: int = TRAIN_BYTES, order: int = ORDER) -> Model | None:
    """Count contexts on Spark, then lay all trees into one table; None without labelled text.

    The counts that reach the driver come from ``most_bytes`` per language at most.
    """
    small_batches(docs.sparkSession)
    sample = training_texts(docs, text, lang, most_bytes).select("lang", utf8("text").alias("text"))
    counts = sample.mapInArrow(_count(order), "lang STRING, k INT, code BIGINT, n BIGINT")
    counts = materialize(counts.groupBy("lang", "k", "code").agg(F.sum("n").alias("n")), "grams").df
    # Only contexts that can become states travel to the driver; there are at most TRAIN_BYTES / LEAST_COUNT of them.
    context = F.shiftright("code", 8)
    often = counts.groupBy("k", context.alias("context")).agg(F.sum("n").alias("all")).filter((F.col("k") < 2) | (F.col("all") >= LEAST_COUNT))
    kept = counts.withColumn("context", context).join(often, ["k", "context"]).select("lang", "k", "code", "n")
    rows = kept.toArrow().to_pandas()
    if not len(rows):
        return None
    return _compile(rows, order)


def _contexts(k: np.ndarray, code: np.ndarray, n: np.ndarray, order: int) -> list[np.ndarray]:
    """Sorted contexts per order.

    A longer one needs its suffix (the state to fall back to) and its prefix
    (the state to come from), so orders are filled one after the other.
    """
    kept = [np.zeros(1, np.int64)]
    for length in range(1, order + 1):
        at = k == length
        codes, inverse = np.unique(code[at] >> 8, return_inverse=True)
        counts = np.bincount(inverse, weights=n[at], minlength=len(codes))
        suffix = codes & ((1 << 8 * (length - 1)) - 1)
        fits = _where(kept[-1], suffix) >= 0
        fits &= _where(kept[-1], codes >> 8) >= 0
        if length > 1:
            fits &= counts >= LEAST_COUNT
        codes, counts = codes[fits], counts[fits]
        room = max(MOST_CONTEXTS - sum(map(len, kept)), 256 if length == 1 else 0)
        kept.append(np.sort(codes[np.lexsort((codes, -counts))[:room]]))
    return kept


def _where(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Positions in a sorted array, -1 for codes that it lacks."""
    if not len(sorted_codes):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return np.where(sorted_codes[at] == codes, at, -1)


def _compile(rows, order: int) -> Model:
    languages = sorted(rows["lang"].unique())
    k, code, n = (rows[c].to_numpy() for c in ("k", "code", "n"))
    contexts = _contexts(k, code, n.astype(float), order)
    used = np.unique(code[k == 0] & 255)
    classes = np.full(256, len(used), np.int64)  # bytes that no language has seen share a class
    classes[used] = np.arange(len(used))
    n_classes = len(used) + 1
    first = np.cumsum([0, *map(len, contexts)])
    step = np.zeros((first[-1], n_classes), np.int32)
    for length, codes in enumerate(contexts):
        own = slice(first[length], first[length + 1])
        if length:
            suffix = _where(contexts[length - 1], codes & ((1 << 8 * (length - 1)) - 1)) + first[length - 1]
            step[own] = step[suffix]
        if length < order:
            longer = contexts[length + 1]
            step[_where(codes, longer >> 8) + first[length], classes[longer & 255]] = first[length + 1] + np.arange(len(longer))
    step[:, -1] = 0
    bits = np.zeros((first[-1], n_classes, len(languages)), np.float32)
    for at, lang in enumerate(languages):
        own = (rows["lang"] == lang).to_numpy()
        counts = []
        for length, codes in enumerate(contexts):
            mine = own & (k == length)
            table = np.zeros((len(codes), n_classes))
            row = _where(codes, code[mine] >> 8)
            np.add.at(table, (row[row >= 0], classes[code[mine][row >= 0] & 255]), n[mine][row >= 0])
            counts.append(table)
        for length in range(order + 1):
            bits[first[length] : first[length + 1], :, at] = _code_lengths(contexts, counts, length, 256 - len(used))
    kind = np.uint8 if n_classes < 256 else np.int64
    return Model(list(languages), classes.astype(kind), n_classes, step.reshape(-1), bits.reshape(-1, len(languages)))


def _code_lengths(contexts: list[np.ndarray], counts: list[np.ndarray], k: int, unused: int) -> np.ndarray:
    """Bits of every byte class after each context of order k, by escapes to ever shorter contexts."""
    codes = contexts[k]
    out = np.zeros((len(codes), counts[0].shape[1]))
    done = np.zeros(out.shape, bool)
    spent = np.zeros((len(codes), 1))
    for length in range(k, -1, -1):
        here = counts[length][_where(contexts[length], codes & ((1 << 8 * length) - 1))]
        here = np.where(done, 0.0, here)
        total, distinct = here.sum(axis=1, keepdims=True), (here > 0).sum(axis=1, keepdims=True)
        whole = np.maximum(total + distinct, 1.0)
        out = np.where(here > 0, spent - np.log2(np.maximum(here, 1e-300) / whole), out)
        spent = np.where(distinct > 0, spent - np.log2(np.maximum(distinct, 1) / whole), spent)
        done |= here > 0
    # Order -1: what is left of the 256 bytes, equally likely; the last class stands for several.
    left = np.maximum((~done[:, :-1]).sum(axis=1, keepdims=True) + unused, 1)
    return np.where(done, out, spent + np.log2(left))


def text_bits(model: Model, texts: list[bytes]) -> np.ndarray:
    """Code length of each text under each language, walking pieces of all texts side by side."""
    order_pad = 8
    lengths = np.array([len(t) for t in texts])
    pieces = np.maximum(-(-lengths // LANE), 1)
    owner = np.repeat(np.arange(len(texts)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    data = np.frombuffer(b"".join(texts) + bytes(LANE), np.uint8)
    begin = (np.cumsum(lengths) - lengths)[owner] + number * LANE
    size = np.minimum(lengths[owner] - number * LANE, LANE)
    order = np.argsort(-size, kind="stable")
    owner, begin, size, number = owner[order], begin[order], size[order], number[order]
    symbols = model.classes[data]
    total = np.zeros((len(owner), len(model.languages)))
    start = _start_state(model)
    state = np.full(len(owner), start, np.int64)
    inner = np.flatnonzero(number > 0)
    # A piece within a text starts from the state that the bytes before it lead to.
    state[inner] = 0
    for back in range(order_pad, 0, -1):
        state[inner] = model.step[state[inner] * model.n_classes + symbols[begin[inner] - back]]
    live = len(owner)
    counts = np.searchsorted(-size, -np.arange(LANE), side="left")  # pieces longer than n
    for n in range(LANE):
        live = int(counts[n])
        if not live:
            break
        at = state[:live] * model.n_classes + symbols[begin[:live] + n]
        total[:live] += model.bits[at]
        state[:live] = model.step[at]
    out = np.zeros((len(texts), len(model.languages)))
    np.add.at(out, owner, total)
    return out


def _start_state(model: Model) -> int:
    """Texts start after zero bytes, as in training."""
    state = 0
    for _ in range(8):
        state = int(model.step[state * model.n_classes + int(model.classes[0])])
    return state


def _score(shared: Broadcast):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        for batch in batches:
            texts = batch.columns[-1].to_pylist()
            found = []
            held: list[bytes] = []
            size = 0
            for t in texts:
                held.append(t)
                size += len(t)
                if size > BATCH_BYTES:
                    found.append(text_bits(model, held))
                    held, size = [], 0
            if held:
                found.append(text_bits(model, held))
            bits = np.concatenate(found) if found else np.zeros((0, len(model.languages)))
            best = bits.argmin(axis=1)
            weights = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0))
            result = pa.StructArray.from_arrays(
                [
                    pa.array([model.languages[b] for b in best], pa.string()),
                    pa.array(1.0 / weights.sum(axis=1)),
                    pa.array(bits.min(axis=1)),
                ],
                names=["lang", "score", "bits"],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], result], names=batch.schema.names)

    return score


def identify(docs: DataFrame, model: Model | None, text: str = "text", prefix: str = "lang_") -> DataFrame:
    """All columns plus ``lang_pred``, ``lang_score`` (0 to 1) and ``lang_bits`` (code length).

    ``und`` with score 0 for null texts, texts without a letter, and without a
    model.  The score is the language's share when each has the weight
    ``2 ** -bits``; equal code lengths go to the first language in byte order.
    Columns of these names are replaced.  The table that is broadcast has at
    most ``MOST_CONTEXTS`` contexts.
    """
    names = [f"{prefix}pred", f"{prefix}score", f"{prefix}bits"]
    kept = docs.drop(*names)
    if model is None:
        return kept.withColumns({names[0]: F.lit(UNKNOWN), names[1]: F.lit(0.0), names[2]: F.lit(None).cast("double")})
    small_batches(docs.sparkSession)
    found = free_name(kept, "found")
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    ready = kept.withColumn(found, utf8(text))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    scored = ready.mapInArrow(_score(shared), f"{fields}, `{found}` STRUCT<lang: STRING, score: DOUBLE, bits: DOUBLE>")
    letters = has_letter(F.col(text))
    return scored.withColumns(
        {
            names[0]: F.when(letters, F.col(found)["lang"]).otherwise(F.lit(UNKNOWN)),
            names[1]: F.when(letters, F.col(found)["score"]).otherwise(F.lit(0.0)),
            names[2]: F.when(letters, F.col(found)["bits"]),
        }
    ).drop(found)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))
