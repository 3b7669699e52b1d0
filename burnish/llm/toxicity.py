"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first letters, so that forms
of one stem share what was learnt. Only features whose presence tells the classes apart beyond
chance have a vector; it starts from their log odds. Filters of several widths run over the words;
the largest answer of each filter in the text feeds a logistic layer. A bounded sample of labelled rows trains the
net; all others then set thresholds for each language, told from the text by its function words, such that
a score of 0.5 is the threshold.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from burnish.functions.scratch import stage

#: The most labelled rows of a class that train the net, and the groups they are drawn from (1,000 each).
LEARN_ROWS, GROUPS = 2000, 2
#: Hash bits of a feature, prefix lengths, vector length, filter widths, filters per width.
HASH_BITS, PREFIXES, SIZE, WIDTHS, FILTERS = 24, (3, 4, 5, 6, 7), 8, (1, 2, 3), 4
#: Standard errors by which a feature's log odds must differ from 0.
CERTAIN = 2.0
EPOCHS, RATE, SEED = 4, 0.02, 7
#: Words of a text that pass the filters at once; neighbouring parts overlap, so no window is lost.
PART = 1 << 15
CACHED = 200_000
#: Rows that a task holds as Python texts.
SLICE = 256
#: Bins of a logit by which labels are counted for the thresholds, and the largest logit told apart.
BINS, LARGEST = 256, 30
_WORD = re.compile(r"[^\W\d_]+")

#: Frequent function words, by which a text's language is told.
FUNCTION_WORDS = {
    "de": "der die das und ist von mit zu den ein eine nicht für sich auf".split(),
    "en": "the of and to in is that it for was with as be on are".split(),
    "es": "el la de que y en los se del las un por con para una".split(),
    "fr": "le la de et les des en un une est du que qui dans pour".split(),
}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def told_language(words: list[str]) -> str:
    """The language most of whose function words occur; '' if none does."""
    seen = set(words)
    return max(sorted(FUNCTION_WORDS), key=lambda name: sum(w in seen for w in FUNCTION_WORDS[name])) if any(w in seen for ws in FUNCTION_WORDS.values() for w in ws) else ""


def features(word: str) -> tuple[int, ...]:
    """Hashes of the word and of its prefixes; a word that is too short for a prefix repeats itself."""
    parts = (word, *(f"{word[:n]}~" if len(word) > n else word for n in PREFIXES))
    return tuple(zlib.crc32(p.encode("utf-8", "replace")) >> (32 - HASH_BITS) for p in parts)


@dataclass
class Net:
    """``rows`` maps a feature's hash to a line of ``vectors``; line 0 is zero and stands for all others."""

    rows: dict[int, int]
    vectors: np.ndarray  # lines x SIZE
    filters: list[np.ndarray]  # by width: width x SIZE x FILTERS
    bias: np.ndarray
    weights: np.ndarray
    intercept: np.ndarray
    thresholds: dict[str, float]

    def lines(self, word: str) -> tuple[int, ...]:
        return tuple(self.rows.get(f, 0) for f in features(word))

    def table(self) -> np.ndarray:
        """SIZE x columns: all filters' positions side by side."""
        return np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)

    def pooled(self, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest answer of each filter and where its window starts; ``answers``: words x columns, padded."""
        best, at, column, n = [], [], 0, len(answers) - max(WIDTHS) + 1
        for width in WIDTHS:
            own = answers[:n, column : column + FILTERS]
            for j in range(1, width):
                own = own + answers[j : n + j, column + j * FILTERS : column + (j + 1) * FILTERS]
            where = own.argmax(0)
            at.append(where)
            best.append(own[where, np.arange(FILTERS)])
            column += width * FILTERS
        return np.concatenate(best), np.concatenate(at)

    def logit(self, pooled: np.ndarray) -> float:
        return float(np.maximum(pooled + self.bias, 0) @ self.weights + self.intercept[0])


def telling(known: np.ndarray) -> np.ndarray:
    """Where windows can hold a word with a vector; ``known`` tells which words have one.

    All other windows answer as the silence does that is put after each text.
    """
    reach = np.concatenate([known, np.zeros(max(WIDTHS) - 1, bool)])
    for _ in range(max(WIDTHS) - 1):
        reach[1:] |= reach[:-1].copy()
    near = reach.copy()
    for _ in range(max(WIDTHS) - 1):
        near[:-1] |= near[1:].copy()
    return np.flatnonzero(near[: len(known)])


def _padded(vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors, np.zeros((2 * max(WIDTHS) - 1, vectors.shape[1]), vectors.dtype)])


def certain_odds(texts: list[list[str]], labels: list[int]) -> dict[int, float]:
    """Log odds of class 1 by feature, as far as they exceed CERTAIN standard errors; others are left out."""
    seen: dict[int, list[int]] = {}
    known: dict[str, tuple[int, ...]] = {}
    for words, label in zip(texts, labels):
        for f in {f for w in set(words) for f in known.setdefault(w, features(w))}:
            seen.setdefault(f, [0, 0])[label] += 1
    totals = (labels.count(0) + 1, labels.count(1) + 1)
    odds = {}
    for f, (without, within) in seen.items():
        value = np.log((within + 0.5) / totals[1]) - np.log((without + 0.5) / totals[0])
        error = CERTAIN * np.sqrt(1 / (within + 0.5) + 1 / (without + 0.5))
        if abs(value) > error:
            odds[f] = float(np.sign(value) * (abs(value) - error))
    return odds


def train(texts: list[list[str]], labels: list[int], epochs: int = EPOCHS) -> Net:
    """Fits a net by stochastic gradient steps with rates that adapt per parameter (Adagrad)."""
    random = np.random.default_rng(SEED)
    odds = certain_odds(texts, labels)
    rows = {f: i for i, f in enumerate(sorted(odds), 1)}
    vectors = (random.standard_normal((len(rows) + 1, SIZE)) * 0.05).astype(np.float32)
    vectors[0] = 0
    vectors[1:, 0] = [odds[f] for f in rows]
    filters = [(random.standard_normal((w, SIZE, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS]
    for own in filters:
        own[:, 0] += 0.5 * np.resize([1, -1], FILTERS)
    count = FILTERS * len(WIDTHS)
    weights = (np.resize([1, -1], count) * 0.3).astype(np.float32)
    net = Net(rows, vectors, filters, np.zeros(count, np.float32), weights, np.full(1, -1, np.float32), {})
    known: dict[str, tuple[int, ...]] = {}
    coded = []
    for words in texts:
        lines = np.array([known.setdefault(w, net.lines(w)) for w in words], np.int64).reshape(-1, 1 + len(PREFIXES))
        coded.append(lines[telling(lines.any(1))])
    squares = {"vectors": np.full_like(net.vectors, 1e-4), "bias": np.full_like(net.bias, 1e-4), "weights": np.full_like(net.weights, 1e-4), "intercept": np.full_like(net.intercept, 1e-4)}
    filter_squares = [np.full_like(f, 1e-4) for f in net.filters]

    def step(value: np.ndarray, square: np.ndarray, gradient: np.ndarray) -> None:
        square += gradient * gradient
        value -= RATE * gradient / np.sqrt(square)

    for _ in range(epochs):
        for i in random.permutation(len(coded)):
            lines = coded[i]
            padded = _padded(net.vectors[lines].sum(1))
            best, at = net.pooled(padded @ net.table())
            raw = best + net.bias
            hidden = np.maximum(raw, 0)
            wrong = 1 / (1 + np.exp(-np.clip(hidden @ net.weights + net.intercept[0], -30, 30))) - labels[i]
            back = np.where(raw > 0, wrong * net.weights, 0).astype(np.float32)
            touched, towards = [], []
            for n, (width, own) in enumerate(zip(WIDTHS, net.filters)):
                part = slice(n * FILTERS, (n + 1) * FILTERS)
                place = at[part][None, :] + np.arange(width)[:, None]  # width x FILTERS
                pull = back[part][None, :, None] * own.transpose(0, 2, 1)  # width x FILTERS x SIZE
                step(own, filter_squares[n], (back[part][None, :, None] * padded[place]).transpose(0, 2, 1))
                inside = place < len(lines)
                touched.append(lines[place[inside]])
                towards.append(pull[inside])
            ids, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            if len(ids):
                total = np.zeros((len(ids), SIZE), np.float32)
                np.add.at(total, inverse.ravel(), np.repeat(np.concatenate(towards), lines.shape[1], axis=0))
                total[ids == 0] = 0
                square = squares["vectors"][ids] + total * total
                squares["vectors"][ids] = square
                net.vectors[ids] -= RATE * total / np.sqrt(square)
            step(net.weights, squares["weights"], (wrong * hidden + 1e-4 * net.weights).astype(np.float32))
            step(net.bias, squares["bias"], back)
            step(net.intercept, squares["intercept"], np.array([wrong], np.float32))
    return net


def calibrate(net: Net, logits: np.ndarray, labels: np.ndarray, languages: list[str], weights: np.ndarray, least: int = 20, times: np.ndarray | None = None) -> None:
    """Sets each language's threshold where the weighted errors are fewest, in the middle if several are.

    A language with fewer than ``least`` rows of either class takes the threshold of all rows. An
    entry stands for as many rows of its label and logit as ``times`` says, for one without it.
    """
    times = np.ones(len(logits), np.int64) if times is None else times
    weights = weights * times

    def threshold(rows: np.ndarray) -> float:
        order = np.argsort(logits[rows], kind="stable")
        x, y, w = logits[rows][order], labels[rows][order], weights[rows][order]
        missed = np.concatenate([[0], np.cumsum(w * y)])  # positives at or below the cut
        alarms = (w * (1 - y)).sum() - np.concatenate([[0], np.cumsum(w * (1 - y))])
        errors = missed + alarms
        edges = np.concatenate([[x[0] - 1], (x[:-1] + x[1:]) / 2, [x[-1] + 1]])
        apart = np.concatenate([[True], x[:-1] < x[1:], [True]])  # equal logits are on one side
        edges, errors = edges[apart], errors[apart]
        good = edges[errors <= errors.min() + 1e-9]
        return float((good[0] + good[-1]) / 2)

    everything = np.arange(len(logits))
    net.thresholds = {"": threshold(everything) if len(logits) else 0.0}
    for name in FUNCTION_WORDS:
        rows = np.flatnonzero(np.array([x == name for x in languages], bool))
        positive = int((labels[rows] * times[rows]).sum())
        net.thresholds[name] = threshold(rows) if min(positive, int(times[rows].sum()) - positive) >= least else net.thresholds[""]


class Scorer:
    """Scores whole texts with a net; keeps the filters' answers to the words met so far."""

    def __init__(self, net: Net):
        self.net, self.columns = net, net.table()
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.lines: dict[tuple[int, ...], int] = {(0,) * (1 + len(PREFIXES)): 0}
        self.answers = np.zeros((1, self.columns.shape[1]), np.float32)

    def look_up(self, words: list[str]) -> np.ndarray:
        new = []
        for w in words:
            if w not in self.words:
                lines = self.net.lines(w)
                if lines not in self.lines:
                    self.lines[lines] = len(self.lines)
                    new.append(lines)
                self.words[w] = self.lines[lines]
        if new:
            self.answers = np.concatenate([self.answers, self.net.vectors[np.array(new)].sum(1) @ self.columns])
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def logit(self, words: list[str]) -> float:
        if len(self.words) > CACHED:
            self.forget()
        best = None
        for start in range(0, max(1, len(words)), PART):
            ids = self.look_up(words[start : start + PART + max(WIDTHS) - 1])
            pooled, _ = self.net.pooled(_padded(self.answers[ids[telling(ids > 0)]]))
            best = pooled if best is None else np.maximum(best, pooled)
        return self.net.logit(best)

    def score(self, text: str) -> float:
        words = words_of(text)
        cut = self.net.thresholds.get(told_language(words), self.net.thresholds[""])
        return 1 / (1 + float(np.exp(-np.clip(self.logit(words) - cut, -30, 30))))


@dataclass(frozen=True)
class Taught:
    """A net without thresholds, and the labelled rows that are left to set them."""

    net: Net
    #: ``doc_id, label`` of labelled rows that did not train the net.
    others: DataFrame
    totals: dict[int, int]


def teach(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", learn_rows: int = LEARN_ROWS) -> Taught | None:
    """Trains a net on rows of ``df`` that ``labels`` (key, label 0/1) marks; None if it marks no rows of both classes.

    At most about ``learn_rows`` rows of each class, those whose keys hash lowest, are collected: a
    bound that does not grow with the input. Four in five of them train the net. A key that is
    labelled twice counts as toxic if one label says so, of rows that repeat a key the text that
    hashes lowest is taken; null keys, labels and texts teach nothing.
    """
    marks = labels.where(f"{key} is not null and {label} is not null").groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    marks = marks.withColumn("at", F.xxhash64("doc_id"))
    totals = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    group = Window.partitionBy("label", F.pmod("at", F.lit(GROUPS))).orderBy("at")
    chosen = marks.withColumn("nth", F.row_number().over(group)).where(F.col("nth") <= learn_rows // GROUPS)
    source = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body")).where("body is not null")
    joined = source.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "at").agg(F.min_by("body", F.struct(F.xxhash64("body"), "body")).alias("body"))
    rows = sorted(((r["at"], r["label"], r["body"], r["doc_id"]) for r in joined.collect()), key=lambda r: r[:2])
    if {r[1] for r in rows} != {0, 1}:
        return None
    taught = [r for i, r in enumerate(rows) if i % 5 < 4]
    net = train([words_of(r[2]) for r in taught], [r[1] for r in taught])
    others = marks.join(F.broadcast(df.sparkSession.createDataFrame([(r[3],) for r in taught], "doc_id long")), "doc_id", "left_anti")
    return Taught(net, others.select("doc_id", "label"), totals)


def tuned(taught: Taught, rated: DataFrame) -> Net:
    """The net with thresholds from all rows of ``rated`` (doc_id, language, logit) that are labelled and did not train it.

    They are weighted so that classes count as often as among all labelled rows. Only counts by
    language, bin of the logit and label are collected (at most 5 x 60 x BINS x 2). Rows that
    repeat a key all count.
    """
    bins = F.floor(F.greatest(F.least(F.col("logit"), F.lit(LARGEST)), F.lit(-LARGEST)) * BINS).cast("int")
    binned = rated.where("doc_id is not null").select("doc_id", "language", bins.alias("bin")).join(taught.others, "doc_id")
    cells = binned.groupBy("language", "bin", "label").agg(F.count("*").alias("n")).orderBy("language", "bin", "label").collect()
    counts = {v: sum(c["n"] for c in cells if c["label"] == v) for v in (0, 1)}
    weights = np.array([taught.totals[c["label"]] / counts[c["label"]] for c in cells])
    calibrate(taught.net, np.array([(c["bin"] + 0.5) / BINS for c in cells]), np.array([c["label"] for c in cells]), [c["language"] for c in cells], weights, times=np.array([c["n"] for c in cells]))
    return taught.net


def learn(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", learn_rows: int = LEARN_ROWS) -> Net | None:
    """A net learnt from ``df``, with thresholds, to score other tables; see teach() and tuned()."""
    taught = teach(df, labels, key, text, label, learn_rows)
    # Rows without a text were never a case for the thresholds.
    return tuned(taught, rate(df.where(F.col(text).isNotNull()), taught.net, key, text)) if taught else None


def rate(df: DataFrame, net: Net, key: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``language, logit``: the told language and the net's answer, before any threshold."""
    source = df.select(F.col(key).cast("long").alias("doc_id"), *keep, F.col(text).cast("string").alias("body"))
    kept = source.drop("body").schema.fields
    schema = StructType([*kept, *StructType.fromDDL("language string, logit double, no_text boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = [words_of(t) for t in part.column("body").to_pylist()]
                made = [pa.array([told_language(t) for t in texts], pa.string()), pa.array([scorer.logit(t) for t in texts], pa.float64()), part.column("body").is_null()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], [f.name for f in schema])

    return source.mapInArrow(run, schema)


def scored(rated: DataFrame, net: Net | None) -> DataFrame:
    """``rated`` with ``score`` and ``predicted`` in place of language and logit."""
    cut = F.lit(net.thresholds[""] if net else 0.0)
    for language, value in (net.thresholds if net else {}).items():
        cut = F.when(F.col("language") == language, F.lit(value)).otherwise(cut)
    over = F.greatest(F.least(F.col("logit") - cut, F.lit(30.0)), F.lit(-30.0))
    score = 1 / (1 + F.exp(-over)) if net else F.lit(0.0)
    return rated.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("language", "logit", "no_text")


def learn_and_score(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", learn_rows: int = LEARN_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``score, predicted``: learn() from ``df`` and score() of it, each text rated once.

    Without a net (nothing to learn from) every score is 0. The rest is as in score().
    """
    taught = teach(df, labels, key, text, label, learn_rows)
    if taught is None:
        blank = df.select(F.col(key).cast("long").alias("doc_id"), *keep, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("logit"))
        return scored(blank, None)
    rated = stage(rate(df, taught.net, key, text, *keep), "rated")
    return scored(rated, tuned(taught, rated.where("not no_text")))


def score(df: DataFrame, net: Net | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted``, a row per input row; only the text is looked at.

    A null text is scored as an empty one. Without a net (nothing to learn from) every score is 0.
    Repeated rows get the same score; other columns are ignored; an empty table gives an empty result.
    """
    if net is None:
        return scored(df.select(F.col(key).cast("long").alias("doc_id")), None)
    return scored(rate(df, net, key, text), net)
