"""Toxic passages by maximum-scoring segments.

Training gives each unit (a word or one of its beginnings) its log-odds of toxic against other
documents under an informative Dirichlet prior. A document is scored by one linear scan that finds
every maximal scoring segment. The scores of the best segments of clean texts follow an
extreme-value law; its two constants turn a segment's score into a surprisal, and a logistic curve
over the largest and the summed significant surprisal gives the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slabs, crc_fold, filled, only, written

#: Labelled documents that training reads at most (those of the smallest hash of their id).
TRAIN_ROWS = 20_000
#: Units with a log-odds beyond so many standard errors and this size get a score of their own. The sample bounds their number.
LEAST_Z, LEAST_ODDS = 4.0, 1.0
#: A unit must occur in so many labelled documents.
LEAST_DOCS = 5
#: Pseudo-documents of the prior.
PRIOR = 20.0
#: All words without a score of their own lose this much, so that long texts have a negative drift.
DRIFT = 0.25
#: Lengths of word beginnings that serve as units.
STEMS = (4, 5, 6)
#: A segment counts as significant from this surprisal on (expected once in e^3 clean texts).
SIGNIFICANT = 3.0
#: Word scores that a worker remembers before it starts afresh.
WORDS_HELD = 400_000
PIECE_CHARS = 1_000_000

_WORD = re.compile(r"\w+")
_SPACE = re.compile(r"\s")


def pieces(text: str) -> Iterator[str]:
    """The whole text in pieces that end at white space, so that very long texts need little memory."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = _SPACE.search(text, at + PIECE_CHARS)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def units(word: str) -> set[str]:
    """The word itself (as ``word$``) and its beginnings."""
    return {word + "$", *(word[:n] for n in STEMS if len(word) > n)}


class WordScores(dict):
    """The score of each word: that of its most certain unit, else the background's."""

    def __init__(self, table: dict[str, tuple[float, float]], background: float) -> None:
        super().__init__()
        self.table, self.background = table, background

    def __missing__(self, word: str) -> float:
        if len(self) > WORDS_HELD:
            self.clear()
        found = [self.table[u] for u in units(word) if u in self.table]
        self[word] = score = max(found, key=lambda x: (x[1], x[0]))[0] if found else self.background
        return score


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, end, score), by one scan in linear time.

    Only positive scores can begin or end a segment, so the scan visits those and takes what lies
    between from running totals. Each open segment remembers the nearest earlier one with a smaller
    left total, so no open segment is looked at twice.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    at = np.flatnonzero(scores > 0)
    found: list[list] = []  # first, end, left total, right total, the nearest earlier with a smaller left total
    for i, low, high in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        first = i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([first, i + 1, low, high, j])
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


@dataclass
class Model:
    table: dict[str, tuple[float, float]]
    background: float
    rate: float = 1.0
    size: float = 1.0
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def scan(self, text: str, words: WordScores) -> tuple[int, list[tuple[int, int, float]], np.ndarray]:
        parts, before = [], ""
        for piece in pieces(text.lower()):
            tokens = _WORD.findall(piece)
            part = np.fromiter(map(words.__getitem__, tokens), dtype=np.float64, count=len(tokens))
            again = [i for i in np.flatnonzero(part > 0).tolist() if tokens[i] == (tokens[i - 1] if i else before)]
            part[again] = 0.0  # a word said over and over is evidence once
            before = tokens[-1] if tokens else before
            parts.append(part)
        scores = parts[0] if len(parts) == 1 else np.concatenate(parts)
        return len(scores), maximal_segments(scores), scores

    def surprisal(self, score: float, n: int) -> float:
        """How surprising so good a segment is in a clean text of n words: -log of the expected number of them."""
        return self.rate * score - math.log(max(self.size * max(n, 1), 1e-9))

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, float]:
        """The largest surprisal and the sum of the significant ones, both on a log scale from 0."""
        each = [self.surprisal(s, n) for _, _, s in segments]
        return math.log1p(max([0.0, *each])), math.log1p(sum(x for x in each if x >= SIGNIFICANT))

    def score(self, evidence: tuple[float, float]) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * evidence[0] + c * evidence[1]))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """A logistic fit by Newton's steps; ``x`` has a column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS, label_name: str = "sample") -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold: ``text``, ``y``; as a table of its own.

    A document labelled several times counts once, with its largest label, and so do equal texts; null ids and labels are left out.
    """
    marks = (
        only(labels, id="doc_id", y=label)
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & (crc_fold(F.col("id")) != 0))
        .groupBy("id")
        .agg(F.max("y").cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    texts = only(docs, id="doc_id", text="text").withColumn("text", filled(F.col("text")))
    # equal texts teach once, so that copies don't make chance words look certain
    return written(texts.join(F.broadcast(marks), "id").groupBy("text").agg(F.max("y").alias("y")), label_name)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits the unit scores, the extreme-value constants and the curve on the labelled sample."""
    sample = labelled_sample(docs, labels, "toxic", rows, "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in by_slabs(batches, "text"):
            seen = (Counter(), Counter())
            for text, y in zip(slab.column("text").to_pylist(), slab.column("y").to_pylist(), strict=True):
                words = {w for piece in pieces(text.lower()) for w in _WORD.findall(piece)}
                seen[int(y > 0)].update({u for w in words for u in units(w)})
                seen[int(y > 0)]["\n"] += 1  # of all documents
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([seen[k][u] for u in names], pa.int64()) for k in (1, 0))], ["unit", "bad", "good"]
            )

    counted = sample.mapInArrow(count, "unit string, bad long, good long").groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counted = written(counted.where((F.col("bad") + F.col("good") >= LEAST_DOCS) | (F.col("unit") == "\n")), "toxicity-units")
    whole = counted.where(F.col("unit") == "\n").first()
    n_bad, n_good = (whole["bad"], whole["good"]) if whole else (0, 0)
    if not n_bad or not n_good:  # nothing to learn from: every text gets the share of toxic labels
        share = (n_bad + 0.5) / (n_bad + n_good + 1.0) if n_bad + n_good else 0.01
        return Model({}, -DRIFT, curve=(math.log(share / (1 - share)), 0.0, 0.0))
    pooled = (F.col("bad") + F.col("good")) / F.lit(float(n_bad + n_good))
    prior = pooled * PRIOR
    odds = [F.log((F.col(c) + prior) / (F.lit(n + PRIOR) - F.col(c) - prior)) for c, n in (("bad", n_bad), ("good", n_good))]
    error = F.sqrt(1 / (F.col("bad") + prior) + 1 / (F.col("good") + prior))
    scored = (
        counted.where((F.col("unit") != "\n") & (pooled < 0.5))
        .select("unit", (odds[0] - odds[1]).alias("score"), error.alias("error"))
        .withColumn("z", F.abs(F.col("score") / F.col("error")))
        .where((F.col("z") >= LEAST_Z) & (F.abs("score") >= LEAST_ODDS))
    )
    model = Model({r["unit"]: (r["score"], r["z"]) for r in scored.collect()}, -DRIFT)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordScores(model.table, model.background)
        for slab in by_slabs(batches, "text"):
            rows: list[tuple] = []
            values: Counter = Counter()
            for text, y in zip(slab.column("text").to_pylist(), slab.column("y").to_pylist(), strict=True):
                n, segments, scores = model.scan(text, words)
                if y <= 0:
                    for v, k in zip(*np.unique(scores.round(3), return_counts=True), strict=True):
                        values[float(v)] += int(k)
                rows.append((int(y > 0), n, max([0.0, *(s for _, _, s in segments)]), 0))
            rows += [(-1, k, v, 0) for v, k in values.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.float64()))], ["y", "n", "best"])

    seen = sample.mapInArrow(measure, "y int, n long, best double")
    seen = seen.groupBy("y", "best", "n").agg(F.count(F.lit(1)).alias("rows")).toPandas()  # bounded by the sample and the table
    value = seen[seen.y == -1]
    value = (value.n * value.rows).groupby(value.best).sum()
    model.rate = decay(value.index.to_numpy(), value.to_numpy(dtype=float))
    clean = seen[(seen.y == 0) & (seen.n > 0)]
    model.size = float(clean.rows.sum() / max(1e-9, (clean.rows * clean.n * np.exp(-model.rate * clean.best)).sum()))
    fit(model, sample)
    return model


def decay(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p e^(rate value) = 1: the decay rate of the extreme-value law."""
    if not len(values) or values.max() <= 0 or (values * counts).sum() >= 0:
        return 1.0
    p, low, high = counts / counts.sum(), 0.0, 1.0
    while (p * np.exp(high * values)).sum() < 1:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * values)).sum() < 1 else (low, mid)
    return high


def fit(model: Model, sample: DataFrame) -> None:
    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordScores(model.table, model.background)
        for slab in by_slabs(batches, "text"):
            rows = [model.evidence(*model.scan(text, words)[:2]) for text in slab.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([slab.column("y"), *(pa.array([r[i] for r in rows], pa.float64()) for i in (0, 1))], ["y", "top", "sum"])

    x = sample.mapInArrow(evidence, "y int, top double, sum double").toPandas()  # TRAIN_ROWS rows at most
    w = logistic(np.column_stack((np.ones(len(x)), x["top"], x["sum"])), (x["y"] > 0).to_numpy(dtype=float))
    model.curve = tuple(float(v) for v in w)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, ``score``, ``predicted`` and ``passages``.

    ``passages`` lists every significant segment as first word, end word, score and surprisal. A null
    text counts as empty; an empty one has no passage and scores what the curve gives for no evidence.
    Repeated rows and null ids are kept. Needs no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordScores(model.table, model.background)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("surprisal", pa.float64())]))
        for slab in by_slabs(batches, "text"):
            scores, passages = [], []
            for text in slab.column("text").to_pylist():
                n, segments, _ = model.scan(text, words)
                scores.append(model.score(model.evidence(n, segments)))
                passages.append([(a, b, s, x) for a, b, s in segments if (x := model.surprisal(s, n)) >= SIGNIFICANT])
            yield pa.RecordBatch.from_arrays([slab.column("id"), pa.array(scores, pa.float64()), pa.array([[dict(zip(("first", "end", "score", "surprisal"), p, strict=True)) for p in ps] for ps in passages], kind)], ["id", "score", "passages"])

    rows = only(docs, id=id_col, text=text_col).withColumn("text", filled(F.col("text")))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, score double, passages array<struct<first: bigint, end: bigint, score: double, surprisal: double>>")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, whatever their names. Needs no shuffle.

    A null text counts as empty and, like an empty one, stays unless the curve rejects texts without evidence; repeated rows
    stay or go together, a score equal to the threshold goes, an empty table gives no rows. Very long texts are read in pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordScores(model.table, model.background)
        for slab in by_slabs(batches, text_col):
            scores = [model.score(model.evidence(*model.scan(text or "", words)[:2])) for text in slab.column(text_col).to_pylist()]
            yield slab.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
