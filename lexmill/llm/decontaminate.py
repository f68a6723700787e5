"""Benchmark passages in documents by the q-gram lemma.

Two texts within e edits of which one has m characters share at least m + 1 - q - q e of its q-grams,
all on diagonals that differ by e at most. Documents are scanned for q-grams of the benchmark; hits
are counted for each item in diagonal bands that overlap by half, so that some band holds all diagonals
of an alignment; bands that reach the bound are verified by aligning the item within the band.
Texts are compared lower-cased with white space runs as one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import best_window
from .common import by_slabs, filled, only

#: Edits allowed for each character of an item.
ERROR = 0.1
#: Characters of a q-gram, for items from so many characters on and for shorter ones.
Q, LONG, Q_SHORT = 8, 40, 4
#: Characters that are hashed together; a worker holds some fifty bytes for each.
SCANNED_AT_ONCE = 1_000_000
#: Benchmark text that one scan of the documents looks for; a larger benchmark takes several scans.
BLOCK_CHARS = 2_000_000
#: Longer documents are scanned in overlapping windows.
WINDOW = 2_000_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_GAP = 0x110000  # no character; stands between documents


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q-gram at each place, by joining hashes of its halves."""
    if len(x) < q:
        return np.zeros(0, dtype=np.uint64)
    power, have = {1: x.astype(np.uint64)}, 1
    while have * 2 <= q:
        h = power[have]
        power[have * 2] = (h[:-have] * _FACTOR) ^ (h[have:] + (h[have:] >> np.uint64(29)))
        have *= 2
    n, out, at = len(x) - q + 1, None, 0
    for size in sorted(power, reverse=True):
        while at + size <= q:
            part = power[size][at : at + n]
            out = part if out is None else (out * _FACTOR) ^ part
            at += size
    return out * _FACTOR


@dataclass
class Items:
    """The items of a block that use the same q."""

    q: int
    ids: list
    texts: list[str]
    budget: np.ndarray
    needed: np.ndarray
    table: np.ndarray
    first: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    seen: np.ndarray
    short: list[np.ndarray]

    @classmethod
    def of(cls, q: int, rows: list[tuple]) -> Items:
        texts = [t for _, t in rows]
        size = np.array([len(t) for t in texts])
        budget = (ERROR * size).astype(np.int64)
        grams = [gram_hashes(points(t), q) for t in texts]
        hashes = np.concatenate(grams)
        item = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
        offset = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(hashes, kind="stable")
        hashes, item, offset = hashes[order], item[order], offset[order]
        new = np.append(True, hashes[1:] != hashes[:-1])
        seen = np.zeros(1 << 22, dtype=bool)
        seen[hashes >> np.uint64(42)] = True
        return cls(q, [i for i, _ in rows], texts, budget, np.maximum(1, size + 1 - q - q * budget), hashes[new], np.append(np.flatnonzero(new), len(hashes)), item, offset, seen, [gram_hashes(points(t), Q_SHORT) for t in texts])

    def matches(self, x: np.ndarray, text: str, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, edits, first, end) of every verified region; ``text`` holds the documents at ``starts``."""
        h = gram_hashes(x, self.q)
        at = np.flatnonzero(self.seen[h >> np.uint64(42)])
        gram = np.minimum(np.searchsorted(self.table, h[at]), len(self.table) - 1)
        same = self.table[gram] == h[at]
        at, gram = at[same], gram[same]
        many = self.first[gram + 1] - self.first[gram]
        where = np.repeat(self.first[gram], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        item, diagonal = self.item[where], np.repeat(at, many) - self.offset[where]
        half = np.maximum(self.budget, 1)
        found = set()
        for shift in (0, 1):
            band = (diagonal + shift * half[item]) // (2 * half[item])
            key, count = np.unique((item.astype(np.int64) << 40) | (band + 8), return_counts=True)
            enough = count >= self.needed[key >> 40]
            for k in key[enough].tolist():
                i, b = k >> 40, (k & ((1 << 40) - 1)) - 8
                low = b * 2 * int(half[i]) - shift * int(half[i])
                found.add((i, low, low + 2 * int(half[i])))
        out = []
        for i, low, high in sorted(found):
            own, m, e = self.texts[i], len(self.texts[i]), int(self.budget[i])
            doc = int(np.searchsorted(starts, max(low + (high - low) // 2 + m // 2, 0), side="right")) - 1
            begin, stop = int(starts[doc]), int(starts[doc + 1]) - 1 if doc + 1 < len(starts) else len(text)
            a, b = max(begin, low - e), min(stop, high + m + e)
            if b <= a:
                continue
            exact = text.find(own, a, b)
            if exact < 0 and m >= LONG and np.isin(self.short[i], gram_hashes(x[a:b], Q_SHORT)).sum() < m + 1 - Q_SHORT - Q_SHORT * e:
                continue  # the same bound for shorter q-grams within the region
            if exact >= 0:
                out.append((doc, i, 0, exact - begin, exact - begin + m))
            elif e and (window := best_window(points(own).astype(np.int64), x[a:b].astype(np.int64), e)):
                out.append((doc, i, window[0], a - begin + window[1], a - begin + window[2]))
        return out


def _groups(rows: list[tuple]) -> list[Items]:
    by_q: dict[int, list[tuple]] = {}
    for item_id, text in rows:
        if text:
            by_q.setdefault(min(len(text), Q if len(text) >= LONG else Q_SHORT), []).append((item_id, text))
    return [Items.of(q, found) for q, found in sorted(by_q.items())]


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[Items]]:
    """The benchmark in blocks of at most ``BLOCK_CHARS`` characters (or one item), each once on the driver."""
    rows, held = [], 0
    for row in only(benchmark, id=id_col, text=text_col).distinct().toLocalIterator():
        text = normal(row["text"] or "")
        if rows and held + len(text) > BLOCK_CHARS:
            yield _groups(rows)
            rows, held = [], 0
        rows.append((row["id"], text))
        held += len(text)
    if rows:
        yield _groups(rows)


def scan(texts: list[str], groups: list[Items]) -> list[tuple[int, object, int, int, int, int]]:
    """(text number, item id, edits, first, end, item characters) of every verified region of the texts."""
    most = max((len(t) + 4 * int(b) + 16 for g in groups for t, b in zip(g.texts, g.budget, strict=True)), default=0)
    windows = []  # text number, offset, part
    for n, text in enumerate(map(normal, texts)):
        for at in range(0, max(1, len(text) - most), max(WINDOW, most)):
            windows.append((n, at, text[at : at + max(WINDOW, most) + most] if len(text) > WINDOW + most else text))
            if len(text) <= WINDOW + most:
                break
    out = []
    held: list[tuple] = []

    def run() -> None:
        starts = np.cumsum([0, *(len(w[2]) + 1 for w in held[:-1])])
        joined = "\n".join(w[2] for w in held)
        x = points(joined).copy()
        x[starts[1:] - 1] = _GAP
        for g in groups:
            for doc, i, edits, first, end in g.matches(x, joined, starts):
                n, at, _ = held[doc]
                out.append((n, g.ids[i], edits, at + first, at + end, len(g.texts[i])))
        held.clear()

    size = 0
    for w in windows:
        if held and size + len(w[2]) > SCANNED_AT_ONCE:
            run()
            size = 0
        held.append(w)
        size += len(w[2])
    if held:
        run()
    return out


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds: ids, ``edits``, ``first``, ``end`` and ``similarity`` of the best place, ``places``.

    Places count characters of the text as compared. Of equally good places the first is given. Null and
    empty texts hold nothing, null and empty items are held by nothing. Rows that share an id count as one
    document, repeated items as one. An empty benchmark gives no rows. Only the found pairs are shuffled.
    """
    rows = only(docs, id=id_col, text=text_col).withColumn("text", filled(F.col("text")))
    kind = rows.schema["id"].dataType.simpleString()
    item_type = only(benchmark, id=item_col).schema["id"].dataType
    schema = f"id {kind}, item {item_type.simpleString()}, edits int, first long, end long, m long"
    spark = docs.sparkSession
    result = spark.createDataFrame([], schema)
    for groups in blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(groups)  # at most BLOCK_CHARS characters and their q-grams

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for slab in by_slabs(batches, "text"):
                found = scan(slab.column("text").to_pylist(), shared.value)
                if found:
                    ids = slab.column("id").take(pa.array([f[0] for f in found], pa.int64()))
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, pa.array([f[1] for f in found]), *(pa.array([f[k + 2] for f in found], kinds[k]) for k in range(4))], ["id", "item", "edits", "first", "end", "m"])

        result = result.union(rows.mapInArrow(run, schema))
    best = result.groupBy("id", "item").agg(F.min(F.struct("edits", "first", "end")).alias("best"), F.first("m").alias("m"), F.countDistinct("first").alias("places"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.edits", "best.first", "best.end", (1 - F.col("best.edits") / F.col("m")).alias("similarity"), "places")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns. Needs no shuffle."""
    for groups in blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(groups)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for slab in by_slabs(batches, text_col):
                held = {f[0] for f in scan([t or "" for t in slab.column(text_col).to_pylist()], shared.value)}
                yield slab.filter(pa.array([n not in held for n in range(slab.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
