"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of five-word shingles; a shingle weighs its number of
occurrences times the mean inverse document frequency of its words.  Consistent
weighted sampling draws from such a set so that two texts draw the same element
with the probability of their weighted Jaccard similarity; 64 draws make 16
bands of four.  Texts that share a band are candidates, and the weighted Jaccard
similarity of the whole texts decides.

Equal texts are one text from the start.  Within a band each text is first
compared with the band's leader, the text that meets most others in all its
bands.  In bands whose texts are not all in one group then, every two texts of
different groups are compared as well, in blocks: the weighted similarities of
two blocks of texts are a matrix product.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stored, materialize
from .common import free_name, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
# Words in fewer texts than this share weigh as if in that share. The table of the others has at most
# (mean distinct words of a text) / COMMON rows, however many texts there are.
COMMON = 1e-3
# Texts, and bytes of texts, of a band that are compared at once with each other or with another block.
BLOCK_TEXTS, BLOCK_BYTES = 1024, 1 << 20
CELLS_AT_ONCE = 16
# Features that lie in a matrix at once.
COLUMNS = 4096
SEED = 7
MEMO_WORDS = 300_000
# Shingles that are sampled together.
AT_ONCE = 1 << 15
QUANTILES = 1 << 13

_MASK = (1 << 64) - 1


def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the Gamma(2, 1) law and their logarithms, at the middles of equal shares."""
    share = (np.arange(QUANTILES) + 0.5) / QUANTILES
    low, high = np.zeros(QUANTILES), np.full(QUANTILES, 60.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - np.exp(-middle) * (1 + middle) < share
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return low.astype(np.float32), np.log(low).astype(np.float32)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), seed=SEED)


class Shingler:
    """Weighted shingles of texts: hashes of five words, and their weights."""

    def __init__(self, idf: dict[str, float], top: float):
        self.idf, self.top = idf, top
        self.memo: dict[str, tuple[int, float]] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.float32)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = (_word_hash(w), self.idf.get(w, self.top))
        pairs = [memo[w] for w in words]
        hashes = np.array([p[0] for p in pairs], np.uint64)
        idf = np.array([p[1] for p in pairs])
        n = max(len(words) - WORDS + 1, 1)
        size = min(WORDS, len(words))  # a shorter text is one shingle
        code, weight = np.full(n, np.uint64(size)), np.zeros(n)
        for i in range(size):
            code = _mixed(code * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
            weight += idf[i : i + n]
        code, inverse, times = np.unique(code, return_inverse=True, return_counts=True)
        mean = np.zeros(len(code))
        mean[inverse] = weight / size
        return code, (mean * times).astype(np.float32)


def draws(codes: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int, quantiles) -> np.ndarray:
    """The element that each of the draws takes from each text's weighted set (texts, draws).

    ``owner`` is ascending and names every text at least once.
    """
    gamma, log_gamma = quantiles
    log_w = np.log(weights)
    out = np.empty((texts, BANDS * ROWS), np.uint64)
    starts = np.searchsorted(owner, np.arange(texts))
    bits = np.uint64(QUANTILES.bit_length() - 1)
    mask = np.uint64(QUANTILES - 1)
    for k in range(BANDS * ROWS):
        h = codes ^ np.uint64(((k + 1) * 0xD6E8FEB86659FD93) & _MASK)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h >>= np.uint64(64 - 13 - 13 - 24)
        r = gamma[(h & mask).astype(np.int32)]
        log_c = log_gamma[((h >> bits) & mask).astype(np.int32)]
        beta = (h >> np.uint64(26)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_w / r + beta)
        log_a = log_c - r * (t - beta + 1)
        least = np.minimum.reduceat(log_a, starts)
        at = np.flatnonzero(log_a == least[owner])
        first = at[np.searchsorted(owner[at], np.arange(texts))]
        # the step belongs to the drawn element, so that equal draws have equal weights up to r
        out[:, k] = codes[first] * np.uint64(0x9E3779B97F4A7C15) + t[first].astype(np.int64).astype(np.uint64)
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return batch

    for batch in batches:
        for text in batch.column(0):
            seen.update(set((text.as_py() or "").lower().split()))
            if len(seen) > MEMO_WORDS:
                yield flush()
    yield flush()


def inverse_frequencies(texts: DataFrame, total: int) -> tuple[dict[str, float], float]:
    """ln(1 / share of texts) + 1 of the words in at least ``COMMON`` of all texts, and that of all others."""
    counts = texts.select("text").mapInArrow(_frequencies, "word STRING, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))
    common = counts.filter(F.col("n") >= max(2.0, COMMON * total)).toArrow()
    top = float(np.log(1 / COMMON)) + 1
    idf = {w: min(top, float(np.log(total / n)) + 1) for w, n in zip(common["word"].to_pylist(), common["n"].to_pylist(), strict=True)}
    return idf, top


def _signatures(shared: Broadcast):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, quantiles = Shingler(*shared.value), _quantiles()
        for batch in batches:
            held: list[tuple[int, np.ndarray, np.ndarray, int]] = []
            size = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = text.as_py() or ""
                codes, weights = shingler(body)
                if len(codes):
                    held.append((key, codes, weights, len(body)))
                    size += len(codes)
                if size >= AT_ONCE:
                    yield _signed(held, quantiles)
                    held, size = [], 0
            if held:
                yield _signed(held, quantiles)

    return sign


def _signed(held: list, quantiles) -> pa.RecordBatch:
    owner = np.repeat(np.arange(len(held)), [len(c) for _, c, _, _ in held])
    drawn = draws(np.concatenate([c for _, c, _, _ in held]), np.concatenate([w for _, _, w, _ in held]), owner, len(held), quantiles)
    bands = np.zeros((len(held), BANDS), np.uint64)
    for row in range(ROWS):
        bands = _mixed(bands * np.uint64(0x9E3779B97F4A7C15) + drawn.reshape(len(held), BANDS, ROWS)[:, :, row])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, np.int32)), pa.array(bands.reshape(-1).view(np.int64)))
    size = pa.array([n for _, _, _, n in held], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([k for k, _, _, _ in held], pa.int64()), size, lists], names=["id", "size", "bands"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of the smaller weights over sum of the larger."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    wa, wb = a[1].astype(float), b[1].astype(float)
    shared = np.minimum(wa[ia], wb[ib]).sum()
    whole = wa.sum() + wb.sum() - shared
    return float(shared / whole) if whole else 1.0


def _verified(shared: Broadcast, least: float):
    """Keep (id, leader) pairs whose texts are similar; rows of a leader come together."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(*shared.value)
        leader, own = None, None
        for batch in batches:
            kept = []
            for n, (i, j) in enumerate(zip(batch.column("id").to_pylist(), batch.column("leader").to_pylist(), strict=True)):
                if leader != j:
                    leader, own = j, shingler(batch.column("leader_text")[n].as_py())
                if similarity(own, shingler(batch.column("text")[n].as_py())) >= least:
                    kept.append((i, j))
            yield pa.RecordBatch.from_arrays([pa.array([p[n] for p in kept], pa.int64()) for n in (0, 1)], names=["id", "leader"])

    return verify


def _components(links: DataFrame) -> Stored:
    """``id, label`` of every linked text: the smallest id that its links lead to.

    Each round takes the smallest label of the neighbours, then the label's own
    label, until nothing changes; the number of rounds grows with the logarithm
    of the longest chain.
    """
    both = links.select("id", F.col("leader").alias("to")).union(links.select(F.col("leader").alias("id"), F.col("id").alias("to"))).distinct()
    both = materialize(both, "links").df
    labels = materialize(both.groupBy("id").agg(F.least(F.min("to"), F.first("id")).alias("label")), "labels")
    while True:
        near = both.join(labels.df.select(F.col("id").alias("to"), "label"), "to").groupBy("id").agg(F.min("label").alias("near"))
        joined = labels.df.join(near, "id", "left").select("id", "label", F.least("label", "near").alias("next"))
        further = labels.df.select(F.col("id").alias("next"), F.col("label").alias("jump"))
        moved = joined.join(further, "next", "left").select("id", F.col("label").alias("before"), F.least("next", "jump").alias("label"))
        moved = materialize(moved, "labels")
        labels = Stored(moved.df.select("id", "label"), moved.rows, moved.path)
        if not moved.df.filter("label <> before").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """All columns of ``docs`` plus ``class_id``: the smallest key among the row's near duplicates.

    Two texts are linked if the weighted Jaccard similarity of their shingles is
    ``least`` or more, and classes are the connected texts.  Equal texts are in
    one class; a null text equals the other null texts, and texts without words
    equal only texts of the same characters.  Texts shorter than five words are
    one shingle.  A row with a null key has the class of its text; if no row of
    the class has a key, ``class_id`` is null.  A column class_id is replaced.
    """
    kept = docs.drop("class_id")
    mine = free_name(kept, "near_print")
    marked = kept.withColumn(mine, _print(text))
    classes = _classes(marked, mine, key, text, least).select(F.col("print").alias(mine), "class_id")
    return marked.join(classes, mine, "left").drop(mine)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of each class of near duplicates: that with the smallest key, null keys last.

    Of rows with equal key and text any one stays.
    """
    mine = free_name(docs, "near_print")
    marked = docs.withColumn(mine, _print(text))
    classes = _classes(marked, mine, key, text, least)
    best = classes.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("no_key"), "first", "print")).alias("best"))
    best = best.select(F.col("best.print").alias("same"), F.col("best.first").alias("least"))
    own = F.col(f"`{key}`").cast("bigint")
    best = materialize(best, "best")
    rows = marked.join(best.df, (F.col(mine) == F.col("same")) & own.eqNullSafe(F.col("least")), "left_semi")
    # Texts move once more only if a key occurs again with the same text; the count moves no texts.
    if rows.select(mine).count() > best.df.count():
        rows = rows.dropDuplicates([mine])
    return rows.drop(mine)


def _print(text: str):
    """Two 64-bit hashes of the whole text stand for it; null has its own."""
    body = F.col(text).cast("string")
    return F.struct(F.xxhash64(body, F.lit(1)).alias("a"), F.xxhash64(F.lit(2), body).alias("b"), body.isNull().alias("c"))


def _classes(marked: DataFrame, mine: str, key: str, text: str, least: float) -> DataFrame:
    """``print, first, label, class_id`` of every distinct text."""
    spark = marked.sparkSession
    small_batches(spark)
    own = F.col(f"`{key}`").cast("bigint")
    prints = marked.groupBy(F.col(mine).alias("print")).agg(F.min(own).alias("first"))
    prints = materialize(prints.select("*", F.monotonically_increasing_id().alias("id")), "prints").df
    # One row of each distinct text goes on; the key in the join spreads the copies of a hot text.
    chosen = marked.select(F.col(mine).alias("print"), F.col(text).cast("string").alias("text"), own.alias("own"))
    once = prints.select(F.col("print").alias("same"), "first", "id")
    texts = chosen.join(once, (F.col("print") == F.col("same")) & F.col("own").eqNullSafe(F.col("first")))
    texts = materialize(texts.filter("text IS NOT NULL").select("id", "text").dropDuplicates(["id"]), "texts").df
    total = max(texts.count(), 1)
    shared = spark.sparkContext.broadcast(inverse_frequencies(texts, total))
    signed = materialize(texts.mapInArrow(_signatures(shared), "id BIGINT, size BIGINT, bands ARRAY<BIGINT>"), "bands").df
    links = _links(texts, signed, shared, least)
    labels = _components(links).df
    classes = prints.join(labels, "id", "left").select("print", "first", F.coalesce("label", "id").alias("label"))
    smallest = classes.groupBy("label").agg(F.min("first").alias("class_id"))
    return materialize(classes.join(smallest, "label"), "classes").df


def _shared(codes: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int, left: int) -> np.ndarray:
    """Sums of the smaller weights of each of the first ``left`` texts with each text.

    A shingle that comes with several weights is one feature per step from one
    weight to the next; a text has those up to its own weight.  Then the smaller
    of two weights is the sum of the steps that both have: a matrix product.
    """
    order = np.lexsort((weights, codes))
    codes, weights, owner = codes[order], weights[order], owner[order]
    code_ends = np.append(codes[1:] != codes[:-1], True)
    step_ends = code_ends | np.append(weights[1:] != weights[:-1], True)
    step = np.concatenate([[0], np.cumsum(step_ends)[:-1]])
    code_starts = np.concatenate([[True], code_ends[:-1]])
    lowest = step[np.maximum.accumulate(np.where(code_starts, np.arange(len(codes)), 0))]
    level = weights[step_ends].astype(float)
    rise = np.diff(level, prepend=0.0)
    first = np.unique(lowest)
    rise[first] = level[first]
    times = step - lowest + 1
    feature = np.repeat(step, times) - (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
    owner = np.repeat(owner, times)
    common = np.bincount(feature, minlength=len(rise)) > 1  # what one text has alone is shared with no other
    number = np.cumsum(common) - 1
    kept = common[feature]
    feature, owner, rise = number[feature[kept]], owner[kept], rise[common]
    order = np.argsort(feature, kind="stable")
    feature, owner = feature[order], owner[order]
    out = np.zeros((left, texts))
    for at in range(0, len(rise), COLUMNS):
        a, b = np.searchsorted(feature, [at, at + COLUMNS])
        has = np.zeros((texts, min(COLUMNS, len(rise) - at)))
        has[owner[a:b], feature[a:b] - at] = 1.0
        out += (has[:left] * rise[at : at + COLUMNS]) @ has.T
    return out


def alike(sets: list[tuple[np.ndarray, np.ndarray]], left: int, least: float) -> np.ndarray:
    """Whether the first ``left`` texts are similar to each of all texts, exactly."""
    owner = np.repeat(np.arange(len(sets)), [len(c) for c, _ in sets])
    codes, weights = np.concatenate([c for c, _ in sets]), np.concatenate([w for _, w in sets])
    whole = np.array([w.astype(float).sum() for _, w in sets])
    shared = _shared(codes, weights, owner, len(sets), left)
    return shared >= least * (whole[:left, None] + whole[None, :] - shared)


def _forest(links: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Links between labels that connect what the linked texts connect: one less than the labels at most."""
    names, number = np.unique(labels, return_inverse=True)
    i, j = np.nonzero(links)
    joined = np.zeros((len(names), len(names)), bool)
    joined[number[i], number[j]] = joined[number[j], number[i]] = True
    open_, found = np.ones(len(names), bool), []
    for start in range(len(names)):
        queue = [start] if open_[start] else []
        open_[start] = False
        while queue:
            at = queue.pop()
            for other in np.flatnonzero(joined[at] & open_).tolist():
                open_[other] = False
                found.append((int(names[other]), int(names[at])))
                queue.append(other)
    return found


def _closed(shared: Broadcast, least: float):
    """(id, leader) links between the labels of a block's texts, or of two blocks', by comparing the texts."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(*shared.value)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for mine, other in zip(batch.column(0), batch.column(1), strict=True):
                texts = [*mine.as_py(), *(other.as_py() or [])]
                left = len(mine)
                labels = np.array([t["label"] for t in texts], np.int64)
                links = alike([shingler(t["text"]) for t in texts], left, least)
                found += _forest(links & (labels[:left, None] != labels[None, :]), labels)
            yield pa.RecordBatch.from_arrays([pa.array([p[n] for p in found], pa.int64()) for n in (0, 1)], names=["id", "leader"])

    return close


def _links(texts: DataFrame, signed: DataFrame, shared: Broadcast, least: float) -> DataFrame:
    """(id, leader) links that connect all texts which share a band and are connected by similar pairs.

    First every text of a band meets the band's leader.  In bands of three and
    more that are not one group then, all texts of different groups meet as
    whole texts, block by block; those of the leader's group meet the others,
    not each other.  A block hands on a forest of links between groups.
    """
    spark = texts.sparkSession
    members = signed.select("id", "size", F.posexplode("bands").alias("band", "code"))
    members = members.select("id", "size", F.xxhash64("band", "code").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Texts without a band in common with another one need no further look.
    members = materialize(members.join(sizes, "bucket").select("bucket", "id", "size", "n"), "members").df
    met = materialize(members.groupBy("id").agg(F.sum("n").alias("met")), "met").df
    texts = materialize(texts.join(met, "id", "left_semi"), "candidates").df
    heads = members.join(met, "id").groupBy("bucket").agg(F.max(F.struct("met", F.xxhash64("id", "bucket").alias("r"), "id")).alias("head"))
    heads = heads.select("bucket", F.col("head.id").alias("leader"))
    pairs = members.join(heads, "bucket").filter("id <> leader").select("id", "leader")
    pairs = pairs.groupBy(F.least("id", "leader").alias("id"), F.greatest("id", "leader").alias("leader")).agg(F.lit(1)).select("id", "leader")
    both = pairs.join(texts, "id").join(texts.select(F.col("id").alias("leader"), F.col("text").alias("leader_text")), "leader")
    met_leader = both.select("id", "leader", "text", "leader_text").mapInArrow(_verified(shared, least), "id BIGINT, leader BIGINT")
    found = materialize(met_leader, "alike").df
    labels = _components(found).df
    ahead = members.filter("n > 2").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    # Bands of the same texts need one look.
    same = [F.bit_xor(F.xxhash64("id", F.lit(n))).alias(f"same{n}") for n in range(2)]
    mixed = ahead.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.first("n").alias("n"), F.sum("size").alias("bytes"), *same)
    mixed = mixed.filter("lo <> hi").groupBy("n", "same0", "same1").agg(F.min(F.struct("bucket", "bytes")).alias("one"))
    mixed = mixed.select("one.*", F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("one.bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    leading = heads.withColumnRenamed("leader", "id").join(labels, "id", "left").select("bucket", F.coalesce("label", "id").alias("leading"))
    mixed = materialize(mixed.join(leading, "bucket").select("bucket", "blocks", "leading"), "mixed")
    if not mixed.rows:
        return found
    place = F.shiftrightunsigned(F.xxhash64("id", "bucket"), 11).cast("double") / float(1 << 53)
    aside = (F.col("blocks") > 1) & (F.col("label") == F.col("leading"))
    laid = ahead.join(mixed.df, "bucket").select("bucket", "id", "label", aside.alias("aside"), F.floor(place * F.col("blocks")).cast("int").alias("block"))
    cells = laid.join(texts, "id").groupBy("bucket", "aside", "block").agg(F.collect_list(F.struct("label", "text")).alias("texts"))
    cells = materialize(cells, "cells").df
    side = lambda n: cells.select("bucket", F.col("aside").alias(f"aside{n}"), F.col("block").alias(f"block{n}"))
    later = "NOT aside1 AND (aside2 OR block1 < block2)"
    meet = side(1).join(side(2), "bucket").filter(later)
    body = lambda n: cells.toDF("bucket", f"aside{n}", f"block{n}", f"texts{n}")
    cross = meet.join(body(1), ["bucket", "aside1", "block1"]).join(body(2), ["bucket", "aside2", "block2"]).select("texts1", "texts2")
    within = cells.filter("NOT aside").select(F.col("texts").alias("texts1"), F.lit(None).cast(cells.schema["texts"].dataType).alias("texts2"))
    small_batches(spark, CELLS_AT_ONCE)
    closed = materialize(within.unionByName(cross).mapInArrow(_closed(shared, least), "id BIGINT, leader BIGINT"), "closed").df
    small_batches(spark)
    return found.union(closed)
