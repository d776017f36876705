"""Toxicity by a support vector machine on a gapped subsequence kernel with Nyström landmarks.

Two strings are similar if they share subsequences of three letters; one that
spans ``s`` letters counts ``DECAY ** (s - 3)``, up to ``SPAN`` letters, so an
insult with letters put in between still matches.  A labelled sentence is a bag
of windows: its words, runs of single letters, and pieces of long words.  A clean
sentence has clean windows only, a toxic one has some toxic windows.  The machine
starts from the windows whose sentences are toxic more often than others, and is
trained in rounds: it picks the strongest windows of each toxic sentence, is
fitted to them against windows of clean sentences, and the clean windows that it
takes for toxic are added.  Landmarks are drawn from both kinds of windows;
kernel values against them, whitened by the landmarks' own kernel matrix, are the
features of a linear machine.  Because its decision is a weighted sum of kernel
values, and those are sums over letter triples, the trained machine is one table
of weights per triple: a window is scored exactly by adding up its triples.  A
text is judged by its strongest windows.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_name, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPAN, DECAY = 7, 0.6
# Letters with a number of their own, the most frequent ones; the others share SHARED numbers.
OWN, SHARED = 47, 16
LANDMARKS, ROUNDS = 192, 3
PENALTY = 1e-5
# Triples of windows that meet the landmarks at once.
PAIRS_AT_ONCE = 1 << 16
# Labelled texts that training uses at most, by hash order; clean windows it starts from. Documented bounds.
TRAIN_TEXTS, TRAIN_WORDS = 16_000, 12_000
# Windows of a toxic text that may be its toxic ones, and how many of them are taken to be; clean windows that a round adds per text.
CANDIDATES, STRONGEST, HARDEST = 20, 3, 3
WINDOW, STRIDE = 32, 24
MEMO_WORDS = 300_000
# Single characters with blanks between them, as in spelled-out words.
_SPELLED = re.compile(r"(?<!\S)(?:\S\s+){3,}\S(?!\S)")


@dataclass
class Model:
    letters: dict[str, int]  # numbers of the frequent letters, 1 to OWN
    table: np.ndarray  # weight per triple of letters, flat
    bias: float
    doc_weights: np.ndarray  # logistic regression over doc_features


def instances(text: str) -> set[str]:
    """Distinct lower-case words of a text without what is no letter or digit.

    Runs of single characters also count as one word; long words are cut into windows.
    """
    text = text.lower()
    words = set(text.split())
    words.update("".join(run.split()) for run in _SPELLED.findall(text))
    words = {w if w.isalnum() else "".join(filter(str.isalnum, w)) for w in words}
    words.discard("")
    long = [w for w in words if len(w) > WINDOW]
    for w in long:
        words.discard(w)
        words.update(w[n : n + WINDOW] for n in range(0, len(w) - WINDOW + STRIDE, STRIDE))
    return words


SIZE = OWN + SHARED + 1


def _number(letter: str, letters: dict[str, int]) -> int:
    """The number of a letter; letters without one of their own share some."""
    return letters.get(letter) or (OWN + 1 + ord(letter) % SHARED if letter != "\0" else 0)


def _coded(words: list[str], letters: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Letter numbers of words of similar length: (positions, matrix), 0 behind a word's end."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    own = np.array(sorted(map(ord, letters)), np.uint32)
    numbers = np.array([letters[chr(c)] for c in own], np.int32)
    for start in range(0, len(order), 4096):
        rows = order[start : start + 4096]
        width = max(int(lengths[rows].max()), 3)
        text = "".join([words[r].ljust(width, "\0") for r in rows])
        flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(flat == 0, 0, OWN + 1 + flat % SHARED).astype(np.int32)
        if len(own):
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            code = np.where(own[at] == flat, numbers[at], code)
        yield rows, code.reshape(len(rows), width)


def _steps() -> list[tuple[int, int, float]]:
    return [(a, b, DECAY ** (b - 2)) for b in range(2, SPAN) for a in range(1, b)]


def triple_sums(words: list[str], letters: dict[str, int], table: np.ndarray) -> np.ndarray:
    """For each word the sum of ``table`` over its triples, weighted by their spans."""
    size = SIZE
    out = np.zeros(len(words))
    for rows, x in _coded(words, letters):
        width = x.shape[1]
        total = np.zeros(len(rows), np.float32)
        for a, b, weight in _steps():
            if b < width:
                code = (x[:, : width - b] * size + x[:, a : width - b + a]) * size + x[:, b:]
                total += weight * table[code].sum(axis=1)
        out[rows] = total
    return out


def _triples(word: str, letters: dict[str, int]) -> np.ndarray:
    """The word's feature vector of unit length, as a flat table."""
    size = SIZE
    x = np.array([_number(c, letters) for c in word])
    table = np.zeros((size, size, size), np.float32)
    for a, b, weight in _steps():
        if b < len(x):
            np.add.at(table, (x[: len(x) - b], x[a : len(x) - b + a], x[b:]), weight)
    return table.reshape(-1) / max(np.sqrt(np.square(table).sum()), 1e-12)


def _sparse(word: str, letters: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    table = _triples(word, letters)
    code = np.flatnonzero(table)
    return code, table[code]


def _against(words: list[str], letters: dict[str, int], used: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Kernel values of words against landmarks: sums of the landmarks' weights over the words' triples."""
    at = np.full(SIZE**3, len(used), np.int32)
    at[used] = np.arange(len(used))
    by_triple = np.ascontiguousarray(features.T)
    out = np.zeros((len(words), len(features)))
    for rows, x in _coded(words, letters):
        width = x.shape[1]
        for a, b, weight in _steps():
            if b < width:
                place = at[(x[:, : width - b] * SIZE + x[:, a : width - b + a]) * SIZE + x[:, b:]]
                row, column = np.nonzero(place < len(used))
                for part in range(0, len(row), PAIRS_AT_ONCE):
                    own, last = row[part : part + PAIRS_AT_ONCE], column[part : part + PAIRS_AT_ONCE]
                    some, first = np.unique(own, return_index=True)
                    out[rows[some]] += weight * np.add.reduceat(by_triple[place[own, last]], first, axis=0)
    return out


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4) -> np.ndarray:
    """Linear machine by Newton steps on the squared hinge loss; the last column is the bias."""
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-9
    for _ in range(30):
        margin = 1 - y * (x @ w)
        on = margin > 0
        # one copy of the rows at a time and one that is weighted: this runs on the driver
        rows = x[on]
        grad = ridge @ w - rows.T @ (weight[on] * y[on] * margin[on])
        step = np.linalg.solve(ridge + (rows * weight[on, None]).T @ rows, grad)
        del rows
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def doc_features(strong: np.ndarray, second: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Strongest and second strongest word, number of toxic words, length; the last column is the bias."""
    clip = lambda v: np.clip(v, -3.0, 3.0)
    return np.column_stack([clip(strong), clip(second), np.log1p(hits), np.log1p(hits / np.log(words + 3.0)), np.ones(len(hits))])


class _Memo(dict):
    """Decisions of words already seen in this task."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > MEMO_WORDS:
            self.clear()
            new = list(words)
        if new:
            self.update(zip(new, (triple_sums(new, self.model.letters, self.model.table) + self.model.bias).tolist(), strict=True))


def _measure(shared: Broadcast):
    """The rows' last column, a text, becomes its four figures."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(Model(**shared.value))
        for batch in batches:
            out: list[tuple] = []
            group: list[set[str]] = []
            size = 0

            def flush(group=group, out=out) -> None:
                memo.learn(set().union(*group))
                for words in group:
                    found = sorted(map(memo.__getitem__, words), reverse=True) if words else []
                    hits = next((n for n, f in enumerate(found) if f <= 0), len(found))
                    out.append((found[0] if found else -3.0, found[1] if len(found) > 1 else -3.0, hits, len(found)))
                group.clear()

            for text in batch.columns[-1]:
                group.append(instances(text.as_py() or ""))
                size += len(group[-1])
                if size > 50_000:
                    flush()
                    size = 0
            flush()
            kinds = (pa.float64(), pa.float64(), pa.int64(), pa.int64())
            columns = [pa.array([r[n] for r in out], kind) for n, kind in enumerate(kinds)]
            result = pa.StructArray.from_arrays(columns, names=["strong", "second", "hits", "words"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], result], names=batch.schema.names)

    return measure


def _measured(docs: DataFrame, model: Model, text: str, found: str) -> DataFrame:
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    kind = "STRUCT<strong: DOUBLE, second: DOUBLE, hits: BIGINT, words: BIGINT>"
    return docs.withColumn(found, F.col(text).cast("string")).mapInArrow(_measure(shared), f"{fields}`{found}` {kind}")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts each word occurs."""
    counts: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        columns = [pa.array(list(counts)), *(pa.array([c[n] for c in counts.values()], pa.int64()) for n in (0, 1))]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, names=["word", "clean", "toxic"])

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in instances(text):
                counts.setdefault(w, [0, 0])[label] += 1
        if len(counts) > MEMO_WORDS:
            yield flush()
    yield flush()


def _hardest(shared: Broadcast):
    """The windows of clean texts that the machine takes for toxic first, and how often."""

    def hardest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(Model(**shared.value))
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                words = instances(text.as_py())
                memo.learn(words)
                found.update(sorted(words, key=lambda w: (-memo[w], w))[:HARDEST])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return hardest


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``bag, word`` of every window of the texts."""
    for batch in batches:
        sets = [sorted(instances(text.as_py())) for text in batch.column(1)]
        bags = np.repeat(batch.column(0).to_numpy(), [len(words) for words in sets])
        yield pa.RecordBatch.from_arrays([pa.array(bags), pa.array([w for words in sets for w in words], pa.string())], names=["bag", "word"])


def _drawn(windows: dict[str, int], count: int) -> list[str]:
    """Windows in a random order, frequent ones rather first."""
    names = sorted(windows)
    weight = np.array([windows[w] for w in names], float)
    order = np.argsort(np.random.default_rng(1).exponential(size=len(names)) / weight, kind="stable")
    return [names[n] for n in order[:count]]


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", most_texts: int = TRAIN_TEXTS) -> Model | None:
    """Train on rows with text and label 0 or 1; at most ``most_texts`` of them, by the hash of the text.

    None only if one of the two labels has no text with a window.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(label).cast("int").alias("label"))
    rows = rows.filter("text IS NOT NULL AND label IN (0, 1)")
    total = rows.count()
    place = F.shiftrightunsigned(F.xxhash64("text"), 11).cast("double") / float(1 << 53)
    sample = rows.filter(place < min(1.0, most_texts / max(total, 1))).dropDuplicates(["text", "label"])
    sample = materialize(sample.withColumn("bag", F.monotonically_increasing_id()), "labelled").df
    bags = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(bags) < 2:
        return None
    counts = sample.select("text", "label").mapInArrow(_words, "word STRING, clean BIGINT, toxic BIGINT").groupBy("word")
    counts = materialize(counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "words").df
    # How much more often a window's sentences are toxic than clean, as if it were in one more of each.
    odds = F.log((F.col("toxic") + 1) / bags[1]) - F.log(F.col("clean") / bags[0] + 1 / bags[1])
    toxic = sample.filter("label = 1").select("bag", "text").mapInArrow(_bags, "bag BIGINT, word STRING").join(counts.select("word", odds.alias("odds")), "word")
    first = Window.partitionBy("bag").orderBy(F.desc("odds"), "word")
    likely = toxic.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= CANDIDATES).select("bag", "word", "odds").toPandas()
    clean = counts.filter("clean > 0").orderBy(F.xxhash64("word"), "word").limit(TRAIN_WORDS).select("word", "clean").collect()
    negative = {r.word: r.clean for r in clean}
    if not len(likely) or not negative:
        return None
    frequency: Counter = Counter(c for w in [*likely["word"], *negative] for c in w)
    letters = {c: n + 1 for n, (c, _) in enumerate(sorted(frequency.items(), key=lambda f: (-f[1], f[0]))[:OWN])}
    strength = likely["odds"].to_numpy()
    for turn in range(ROUNDS):
        order = likely.assign(strength=strength).sort_values(["bag", "strength", "word"], ascending=[True, False, True])
        positive = Counter(order.groupby("bag").head(STRONGEST)["word"])
        model = _fit_windows(positive, negative, letters)
        if turn + 1 < ROUNDS:
            strength = likely["odds"].to_numpy() + triple_sums(list(likely["word"]), letters, model.table) + model.bias
            shared = spark.sparkContext.broadcast(vars(model))
            hard = sample.filter("label = 0").select("text").mapInArrow(_hardest(shared), "word STRING, n BIGINT")
            for r in hard.groupBy("word").agg(F.sum("n").alias("n")).collect():
                negative[r.word] = negative.get(r.word, 0) + r.n
    measured = _measured(sample.select("label", "text"), model, "text", "found").select("label", "found.*").toPandas()
    x = doc_features(*(measured[c].to_numpy(float) for c in ("strong", "second", "hits", "words")))
    model.doc_weights = _logistic(x, measured["label"].to_numpy(float))
    return model


def _fit_windows(positive: dict[str, int], negative: dict[str, int], letters: dict[str, int]) -> Model:
    """The machine that sets windows apart, each weighing as often as it came up; both kinds weigh the same."""
    landmarks = list(dict.fromkeys(_drawn(positive, LANDMARKS // 2) + _drawn(negative, LANDMARKS // 2)))
    found = [_sparse(w, letters) for w in landmarks]
    used = np.unique(np.concatenate([code for code, _ in found]))
    # the landmarks' weights of the triples that any of them has; the last column is that of all other triples
    features = np.zeros((len(landmarks), len(used) + 1), np.float32)
    for row, (code, weight) in zip(features, found, strict=True):
        row[np.searchsorted(used, code)] = weight
    own = (features @ features.T).astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    good = values > 1e-6 * max(values.max(), 1e-12)
    whiten = (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T
    words = [*positive, *negative]
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    x = np.empty((len(y), len(whiten) + 1))
    x[:, :-1] = _against(words, letters, used, features) @ whiten
    x[:, -1] = 1.0
    weight = np.array([n / (2 * sum(side.values())) for side in (positive, negative) for n in side.values()])
    w = _squared_hinge(x, y, weight, PENALTY)
    table = np.zeros(SIZE**3, np.float32)
    table[used] = (whiten @ w[:-1] @ features)[:-1]
    return Model(letters, table, float(w[-1]), np.zeros(5))


def score(docs: DataFrame, model: Model | None, text: str = "text", name: str = "toxicity") -> DataFrame:
    """All columns plus ``toxicity``, 0 to 1; whole texts, however long.

    Null and empty texts get the score of a text without words.  Without a model
    (labels of one kind only) nothing is known to be toxic, and every score is 0.
    A column of the name is replaced.
    """
    kept = docs.drop(name)
    if model is None:
        return kept.withColumn(name, F.lit(0.0))
    found = free_name(kept, "found")
    part = lambda c: F.col(found)[c].cast("double")
    clip = lambda c: F.greatest(F.lit(-3.0), F.least(F.lit(3.0), c))
    x = [clip(part("strong")), clip(part("second")), F.log1p(part("hits")), F.log1p(part("hits") / F.log(part("words") + 3.0)), F.lit(1.0)]
    logit = sum((a * F.lit(float(b)) for a, b in zip(x, model.doc_weights, strict=True)), F.lit(0.0))
    return _measured(kept, model, text, found).withColumn(name, 1 / (1 + F.exp(-logit))).drop(found)
