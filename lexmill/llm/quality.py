"""Quality scores by a factorisation machine.

A text's features are its hashed words (weights of unit length together), one-hot steps of structure
statistics, and the step of its length as metadata. All pairs of features interact through low-rank factors; the
sum over pairs is taken in time linear in the number of features as half of (the squared sum minus the
sum of squares), factor by factor.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slabs, filled, only
from .toxicity import labelled_sample, pieces

#: Labelled documents that training reads at most.
TRAIN_ROWS = 10_000
#: Buckets of hashed words, factors of a feature, steps of a statistic.
BUCKETS, RANK, STEPS = 1 << 14, 6, 12
#: Words whose bucket a worker remembers.
WORDS_HELD = 300_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")

#: Each statistic: name, and the value at which its last step begins.
STATISTICS = (("upper", 0.5), ("lower", 1.0), ("digit", 0.2), ("punctuation", 0.3), ("space", 0.4), ("other", 0.5), ("token_length", 12.0), ("distinct", 1.0), ("repeated_lines", 1.0), ("line_length", 1.0), ("top_token", 0.5), ("sentence", 1.0), ("length", 24.0))
FEATURES = BUCKETS + len(STATISTICS) * (STEPS + 1)

# classes of ASCII characters: 0 upper, 1 lower, 2 digit, 3 punctuation, 4 space; 5 is anything beyond ASCII
_CLASS = np.full(128, 3, dtype=np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]] = 0, 1, 2, 4


class Buckets(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > WORDS_HELD:
            self.clear()
        self[token] = bucket = zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        return bucket


def features(text: str, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of the whole text."""
    counts = np.zeros(6, dtype=np.int64)
    words, tokens, length = np.zeros(0, dtype=np.int64), 0, 0
    parts, distinct = [], set()
    for piece in pieces(text):
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        low = points[points < 128]
        counts += np.bincount(_CLASS[low], minlength=6)
        counts[5] += len(points) - len(low)
        found = _TOKEN.findall(piece)
        tokens += len(found)
        length += sum(map(len, found))
        distinct.update(found)
        parts.append(np.fromiter(map(buckets.__getitem__, found), dtype=np.int64, count=len(found)))
    words = np.concatenate(parts)
    at, times = np.unique(words, return_counts=True)
    value = np.log1p(times)
    norm = math.sqrt(float((value * value).sum())) or 1.0
    lines = [x for x in text.split("\n") if x.strip()]
    sizes: dict[str, int] = {}
    for x in lines:
        sizes[x] = sizes.get(x, 0) + 1
    repeated = sum(n - 1 for n in sizes.values())
    n = max(1, len(text))
    measured = {
        "upper": counts[0] / n, "lower": counts[1] / n, "digit": counts[2] / n, "punctuation": counts[3] / n, "space": counts[4] / n, "other": counts[5] / n,
        "token_length": length / max(1, tokens), "distinct": len(distinct) / max(1, tokens), "repeated_lines": repeated / max(1, len(lines)),
        "line_length": min(1.0, len(text) / max(1, len(lines)) / 2000), "top_token": times.max() / tokens if tokens else 0.0,
        "sentence": min(1.0, (text.count(".") + text.count("!") + text.count("?")) * 10 / max(1, tokens)), "length": math.log2(n),
    }
    steps = [BUCKETS + k * (STEPS + 1) + min(STEPS, int(STEPS * float(measured[name]) / top)) for k, (name, top) in enumerate(STATISTICS)]
    return np.concatenate((at, steps)), np.concatenate((value / norm, np.full(len(steps), 0.5)))


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, value: np.ndarray) -> float:
        """Bias, linear terms and all pairs: half of squared sum less sum of squares, for each factor."""
        v = self.factors[at] * value[:, None]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[at] @ value + 0.5 * (total @ total - (v * v).sum()))

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.raw(at, value)))))


def learn(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 16, batch: int = 128, rate: float = 0.1, ridge: float = 1e-4) -> Machine:
    """AdaGrad on the logistic loss over the bounded sample, from a fixed seed."""
    rng = np.random.default_rng(10)
    share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
    m = Machine(math.log(share / (1 - share)), np.zeros(FEATURES), rng.normal(0, 0.03, (FEATURES, RANK)))
    if not len(y) or y.min() == y.max():
        m.factors[:] = 0
        return m
    g_w, g_v, g_b = np.full(FEATURES, 1e-2), np.full((FEATURES, RANK), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            at = np.concatenate([rows[r][0] for r in part])
            value = np.concatenate([rows[r][1] for r in part])
            size = np.array([len(rows[r][0]) for r in part])
            start = np.cumsum(size) - size
            v = m.factors[at] * value[:, None]
            total = np.add.reduceat(v, start)
            pairs = 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((v * v).sum(axis=1), start))
            raw = m.bias + np.add.reduceat(m.weights[at] * value, start) + pairs
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
            each = np.repeat(error, size) * value
            used, back = np.unique(at, return_inverse=True)
            d_w = np.bincount(back, each) + ridge * m.weights[used]
            pull = each[:, None] * (np.repeat(total, size, axis=0) - v)
            d_v = np.stack([np.bincount(back, pull[:, f]) for f in range(RANK)], axis=1) + ridge * m.factors[used]
            g_w[used] += d_w**2
            g_v[used] += d_v**2
            g_b += error.sum() ** 2
            m.weights[used] -= rate * d_w / np.sqrt(g_w[used])
            m.factors[used] -= rate * d_v / np.sqrt(g_v[used])
            m.bias -= rate * error.sum() / math.sqrt(g_b)
    return m


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fits the machine on at most ``rows`` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", rows, "quality-sample")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for slab in by_slabs(batches, "text"):
            found = [features(text, buckets) for text in slab.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [slab.column("y"), pa.array([a.tolist() for a, _ in found], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in found], pa.list_(pa.float32()))], ["y", "at", "value"]
            )

    # bounded: TRAIN_ROWS rows of at most FEATURES numbers
    got = sample.mapInArrow(extract, "y int, at array<int>, value array<float>").toArrow()
    at, value = got.column("at").combine_chunks(), got.column("value").combine_chunks()
    pairs = [(np.asarray(a.values, dtype=np.int64), np.asarray(v.values, dtype=np.float64)) for a, v in zip(at, value, strict=True)]
    return learn(pairs, (np.asarray(got.column("y").to_pylist(), dtype=np.float64) > 0).astype(np.float64))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: id, ``score`` (higher: better) and ``predicted``.

    A null text counts as empty; an empty one is scored by its structure alone. Repeated rows and
    null ids are kept; whole texts are read. Needs no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a fixed size: FEATURES x (RANK + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for slab in by_slabs(batches, "text"):
            scores = [shared.value.score(*features(text, buckets)) for text in slab.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([slab.column("id"), pa.array(scores, pa.float64())], ["id", "score"])

    rows = only(docs, id=id_col, text=text_col).withColumn("text", filled(F.col("text")))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
