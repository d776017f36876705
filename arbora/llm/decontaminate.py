"""Benchmark decontamination: rare word triples seed, Smith-Waterman alignment decides.

Triples of words of the test items, in a row or with one word between, are looked
up in every text.  How many texts
hold each triple is counted first; a triple seeds an alignment if it is rare in
the corpus or among the rarer half of its item's that occur.  A frequent one, be
it a common phrase or part of an item with many copies, seeds as well if its words
are in a row and those around it could reach the least score at all.  Around the seeds the item is
aligned with the text word by word, so copies with words changed, put in or left
out still score.  Left and right of a copy the alignment goes on, and long runs of
seeds are aligned window by window.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The words of a triple, counted from its first; copies with every third word changed keep some of the second kind.
PATTERNS = ((0, 1, 2), (0, 1, 3))
SEED_WORDS, LEAST_WORDS = 4, 5
# Words of a run that are aligned at once, in lengths of the item.
WINDOW = 6
# A triple in at most this share of the texts, or this number of them, is rare.
RARE, RARE_TEXTS = 1e-3, 20
MATCH, ALIKE, MISMATCH, GAP = 2.0, 1.0, -1.0, -1.0
# Words that are looked up together; a longer text is alone.
WORDS_AT_ONCE = 100_000
# Alignment score by that of the whole item from which a passage counts as a copy.
LEAST_SCORE = 0.5
# Bytes of items that one pass over the texts looks for; a larger benchmark takes several passes.
ITEM_BYTES = 16 << 20
FOUND = "ARRAY<STRUCT<item_id: BIGINT, score: DOUBLE, first_word: INT, words: INT>>"
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Seeds:
    """The items' words as numbers and their triples in order."""

    def __init__(self, items: list[tuple[int, str]]):
        listed = [(i, words_of(t)) for i, t in items]
        self.items = [(i, w) for i, w in listed if len(w) >= LEAST_WORDS]
        self.number = {w: n + 1 for n, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        coded = [self.coded(w) for _, w in self.items]
        codes = [self.triples(c)[0] for c in coded]
        owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes]) if codes else np.zeros(0, int)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.codes, first = np.unique(flat[order], return_index=True)
        self.bounds, self.owner = np.append(first, len(flat)), owner[order]
        gapped = [self.triples(c)[2] for c in coded]
        self.gapped = np.concatenate(gapped)[order] if gapped else np.zeros(0, bool)
        self.words = coded
        self.known: dict[int, tuple[dict, dict]] = {}

    def reach(self, item: int, window: list[str]) -> float:
        """No alignment of the item with these words scores more: each word of the item counts once."""
        if item not in self.known:
            words = self.items[item][1]
            self.known[item] = dict(Counter(words)), {w: w[:4] for w in words if len(w) > 4}
        times, stems = self.known[item]
        there = set(window)
        exact = sum(n for w, n in times.items() if w in there)
        missing = [w for w in stems if w not in there]
        alike = {w[:4] for w in there if len(w) > 4} if missing else set()
        return MATCH * exact + ALIKE * sum(times[w] for w in missing if stems[w] in alike)

    def coded(self, words: list[str]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words], np.uint64)

    def triples(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A number for each triple of known words, where it begins, and whether a word is between."""
        codes, places = [np.zeros(0, np.uint64)], [np.zeros(0, int)]
        for pattern in PATTERNS:
            n = len(coded) - pattern[-1]
            if n <= 0:
                continue
            a, b, c = (coded[k : k + n] for k in pattern)
            at = np.flatnonzero((a > 0) & (b > 0) & (c > 0))
            code = (a[at] * np.uint64(0x9E3779B97F4A7C15) + b[at]) * np.uint64(0x9E3779B97F4A7C15) + c[at]
            codes.append(code * np.uint64(2 * pattern[-1] + 1))
            places.append(at)
        gapped = np.repeat([False, *(p != PATTERNS[0] for p in PATTERNS)][: len(codes)], [len(c) for c in codes])
        return np.concatenate(codes), np.concatenate(places), gapped

    def hits(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the text's triples that items have, and which."""
        code, at, _ = self.triples(coded)
        if not len(at) or not len(self.codes):
            return np.zeros(0, int), np.zeros(0, int)
        found = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        same = self.codes[found] == code
        return at[same], found[same]


def _in_texts(seeds: Seeds, texts: Iterator[str | None]) -> Iterator[tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]]:
    """Words of some texts at a time, and the items' triples in them: text, position, and which."""
    get = seeds.number.get
    held: list[list[str]] = []
    flat: list[int] = []
    starts: list[int] = []

    def looked_up():
        at, which = seeds.hits(np.array(flat, np.uint64))
        text = np.searchsorted(starts, at, "right") - 1
        order = np.argsort(text, kind="stable")
        return held, text[order], (at - np.array(starts)[text])[order], which[order]

    for body in texts:
        words = words_of(body or "")
        held.append(words)
        starts.append(len(flat))
        flat.extend([get(w, 0) for w in words])
        flat.extend([0] * SEED_WORDS)  # no triple runs over a text's end
        if len(flat) > WORDS_AT_ONCE:
            yield looked_up()
            held, flat, starts = [], [], []
    if held:
        yield looked_up()


def _counted(shared: Broadcast):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: Seeds = Seeds(shared.value)
        texts, total = np.zeros(len(seeds.codes), np.int64), 0
        for batch in batches:
            for held, text, _, which in _in_texts(seeds, (t.as_py() for t in batch.column(0))):
                once = np.unique(text * max(len(seeds.codes), 1) + which) % max(len(seeds.codes), 1)
                texts += np.bincount(once, minlength=len(texts))
                total += len(held)
        at = np.flatnonzero(texts)
        columns = [pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(texts[at], total))]
        yield pa.RecordBatch.from_arrays(columns, names=["seed", "n"])

    return count


def rare_seeds(seeds: Seeds, texts: np.ndarray, total: int) -> np.ndarray:
    """Whether each (triple, item) pair may seed: rare in the corpus, or in the rarer half of the item's that occur."""
    n = texts[np.repeat(np.arange(len(seeds.codes)), np.diff(seeds.bounds))]
    rare = n <= max(RARE * total, RARE_TEXTS)
    own = np.flatnonzero(n > 0)
    own = own[np.lexsort((n[own], seeds.owner[own]))]
    first = np.searchsorted(seeds.owner[own], np.arange(len(seeds.items) + 1))
    place = np.arange(len(own)) - first[seeds.owner[own]]
    half = -(-np.diff(first) // 2)
    rare[own[place < half[seeds.owner[own]]]] = True
    return rare


def align(item: list[str], text: list[str]) -> tuple[float, int, int]:
    """Best local alignment: score, first word and end of the aligned part of ``text``.

    A row per item word; gaps along the row by a running maximum.
    """
    number: dict[str, int] = {}
    code = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws])
    a, b = code(item), code(text)
    stem = lambda ws: np.array([number.setdefault("\0" + w[:4], len(number)) if len(w) > 4 else -1 - n for n, w in enumerate(ws)])
    sa, sb = stem(item), stem(text)
    sb = np.where(sb < 0, -(1 << 40), sb)
    steps = GAP * np.arange(len(b) + 1)
    rows = [np.zeros(len(b) + 1)]
    for i in range(len(a)):
        score = np.where(b == a[i], MATCH, np.where(sb == sa[i], ALIKE, MISMATCH))
        row = np.zeros(len(b) + 1)
        row[1:] = np.maximum(np.maximum(rows[-1][:-1] + score, rows[-1][1:] + GAP), 0.0)
        row = np.maximum.accumulate(row - steps) + steps
        rows.append(row)
    table = np.array(rows)
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    best, end = float(table[i, j]), int(j)
    while i and j and table[i, j] > 0:
        score = MATCH if b[j - 1] == a[i - 1] else ALIKE if sb[j - 1] == sa[i - 1] else MISMATCH
        if table[i, j] == table[i - 1, j - 1] + score:
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return best, int(j), end


def passages(seeds: Seeds, rare: np.ndarray, words: list[str], least: float) -> list[dict]:
    """Copies of items in one text: the best alignments around each run of seeds."""
    return _passages(seeds, rare, words, *seeds.hits(seeds.coded(words)), least)


def _passages(seeds: Seeds, rare: np.ndarray, words: list[str], at: np.ndarray, which: np.ndarray, least: float) -> list[dict]:
    if not len(at):
        return []
    counts = np.diff(seeds.bounds)[which]
    pairs = np.repeat(seeds.bounds[which], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    item, place, rare, plain = seeds.owner[pairs], np.repeat(at, counts), rare[pairs], ~seeds.gapped[pairs]
    order = np.lexsort((place, item))
    item, place, rare, plain = item[order], place[order], rare[order], plain[order]
    out, covered = [], {}
    for key, low, high, passage in _runs(seeds, item[rare], place[rare], words, least):
        out.append(passage)
        covered.setdefault(key, []).append((low, high))
    # Frequent triples outside the surroundings of these passages.
    other = np.flatnonzero(~rare & plain)
    able = np.zeros(len(other), bool)
    before, reached = -1, 0
    for n, (key, p) in enumerate(zip(item[other].tolist(), place[other].tolist(), strict=True)):
        own = seeds.items[key][1]
        if any(low <= p < high for low, high in covered.get(key, ())):
            continue
        # Next to a triple that seeds another one only widens the run.
        if key == before and p - reached <= len(own):
            able[n] = True
        else:
            able[n] = seeds.reach(key, words[max(0, p - len(own)) : p + len(own) + SEED_WORDS]) >= least * MATCH * len(own)
        if able[n]:
            before, reached = key, p
    out += [passage for *_, passage in _runs(seeds, item[other[able]], place[other[able]], words, least)]
    return out


def _runs(seeds: Seeds, item: np.ndarray, place: np.ndarray, words: list[str], least: float) -> Iterator[tuple[int, int, int, dict]]:
    """Item, surroundings and passage of each run of seeds that holds a copy; the places ascend within each item."""
    start = 0
    for n in range(1, len(item) + 1):
        if n < len(item) and item[n] == item[start] and place[n] - place[n - 1] <= len(seeds.items[item[start]][1]):
            continue
        key, own = seeds.items[item[start]]
        low, high = max(0, int(place[start]) - len(own)), int(place[n - 1]) + len(own) + SEED_WORDS
        for score, first, end in copies(own, words, place[start:n], low, min(high, len(words)), least):
            found = {"item_id": key, "score": score / (MATCH * len(own)), "first_word": first, "words": end - first}
            yield int(item[start]), low, high, found
        start = n


def copies(
    item: list[str], words: list[str], seeded: np.ndarray, low: int, high: int, least: float
) -> Iterator[tuple[float, int, int]]:
    """Score, first word and end of the copies of an item in ``words[low:high]`` that hold a seed, from left to right.

    A copy of the least score has fewer changes than words, so it is at most
    twice as long as the item.  Windows overlap by as much; a copy that begins in
    the overlap is left to the next window.
    """
    reach = 2 * len(item)
    while low < high:
        last = low + WINDOW * len(item) >= high
        end = high if last else low + WINDOW * len(item)
        after = end if last else end - reach
        for score, first, stop in _within(item, words, seeded, low, end, least):
            if first < end - reach or last:
                yield score, first, stop
                after = max(after, stop)
        low = after


def _within(
    item: list[str], words: list[str], seeded: np.ndarray, low: int, high: int, least: float
) -> list[tuple[float, int, int]]:
    """The best copy between two places, and those left and right of it."""
    found, open_ = [], [(low, high)]
    while open_:
        a, b = open_.pop()
        # so few words cannot reach the score, and words without a seed are none of a copy
        if b - a < least * len(item) or np.searchsorted(seeded, a) == np.searchsorted(seeded, b):
            continue
        score, first, end = align(item, words[a:b])
        if score >= least * MATCH * len(item):
            found.append((score, a + first, a + end))
            open_ += [(a, a + first), (a + end, b)]
    return sorted(found, key=lambda f: f[1])


def _found(shared: Broadcast, rare: Broadcast, least: float):
    """Append the passages to the list in the last column; the text is the one before."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(shared.value)
        for batch in batches:
            found = [before or [] for before in batch.columns[-1].to_pylist()]
            row = 0
            for held, text, at, which in _in_texts(seeds, (t.as_py() for t in batch.columns[-2])):
                bounds = np.searchsorted(text, np.arange(len(held) + 1))
                for n in np.unique(text).tolist():
                    own = slice(bounds[n], bounds[n + 1])
                    found[row + n] = found[row + n] + _passages(seeds, rare.value, held[n], at[own], which[own], least)
                row += len(held)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, batch.schema.field(batch.num_columns - 1).type)], names=batch.schema.names
            )

    return find


def flag(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: float = LEAST_SCORE,
    name: str = "leaks",
) -> DataFrame:
    """All columns plus ``leaks``: the copies of test items in the row's text, an empty list if none.

    A copy has the item's id, its alignment score as a share of the whole item's,
    and its place in words.  Items of fewer than five words say too little and
    match nothing; null ids, null items and null or empty texts give no copies.
    Equal items are each reported.  A column of the name is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t"))
    items = items.filter("i IS NOT NULL AND t IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = max(1, -(-size // ITEM_BYTES))
    kept = docs.drop(name)
    body, found = free_name(kept, "leak_text"), free_name(kept, "leak_list")
    ready = kept.withColumn(body, F.col(text).cast("string")).withColumn(found, F.expr(f"CAST(array() AS {FOUND})"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields)
    for n in range(passes):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == n)
        listed = sorted((r.i, r.t) for r in part.toLocalIterator())
        seeds = Seeds(listed)
        shared = spark.sparkContext.broadcast(listed)
        counts = docs.select(F.col(text).cast("string")).mapInArrow(_counted(shared), "seed INT, n BIGINT")
        sums = {r.seed: r.n for r in counts.groupBy("seed").agg(F.sum("n").alias("n")).collect()}
        total = sums.pop(-1, 0)
        texts = np.zeros(len(seeds.codes), np.int64)
        texts[list(sums)] = list(sums.values())
        rare = spark.sparkContext.broadcast(rare_seeds(seeds, texts, total))
        ready = ready.mapInArrow(_found(shared, rare, least), schema)
    return ready.withColumnRenamed(found, name).drop(body)
