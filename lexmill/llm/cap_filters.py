"""Near-duplicate vectors by spherical-cap filters.

Filter directions form a structured product code: the (rotated) space is cut into blocks, each block
has a short list of random unit codewords, and a direction is one codeword of every block. A vector
is list-decoded to all directions whose cap it lies in, block by block with a bound on what the rest
can still add, so the many directions are never gone through one by one. Vectors meet in filters and
every pair that meets is compared exactly in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, only, written
from .components import components

#: Filters that a pair right at the threshold shares on average; a pair is missed with about e to the minus this.
SHARED = 12.0
#: Unrelated vectors that a filter catches on average.
CROWD = 48.0
#: Rows of a filter that one task compares with as many others; fuller filters are cut in blocks.
BLOCK = 512
#: Codewords of a block at most; larger codes get more blocks.
WORDS = 1024
#: Independent codes that share the directions: the directions of one code hang together, so a vector that
#: few of its caps catch would have no other chance.
CODES = 6


def plan(n: int, cosine: float) -> tuple[float, float]:
    """The cap's height in standard deviations and how many directions the code needs, for ``n`` vectors."""
    normal = NormalDist()
    share = min(0.1, CROWD / max(n, 1))
    height = normal.inv_cdf(1 - share)
    # chance that the other vector of a pair at the threshold lies in a cap that one of them lies in
    steps = np.linspace(height, height + 8, 4001)
    density = np.exp(-(steps**2) / 2)
    tail = np.array([1 - normal.cdf((height - cosine * s) / math.sqrt(1 - cosine**2)) for s in steps[::20]])
    together = float((density[::20] * tail).sum() / density[::20].sum())
    return height, SHARED / together / share


@lru_cache(maxsize=4 * CODES)
def code(dim: int, directions: float, which: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rotation and the codewords of each block, from fixed seeds."""
    blocks = 1
    while blocks < dim and directions ** (1 / blocks) > WORDS:
        blocks += 1
    rng = np.random.default_rng([dim, which])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    count = math.ceil(directions ** (1 / blocks))
    words = []
    for part in np.array_split(np.arange(dim), blocks):
        w = rng.standard_normal((count, len(part)))
        # a block's share of a unit direction is the square root of its share of the dimensions
        words.append(w / np.linalg.norm(w, axis=1, keepdims=True) * math.sqrt(len(part) / dim))
    return turn, words


def list_decode(vector: np.ndarray, dim: int, height: float, directions: float) -> np.ndarray:
    """Numbers of all directions of all codes that catch the unit vector, ascending."""
    one = math.ceil(directions / CODES)
    return np.concatenate([_decode(vector, dim, height, one, k) + (k << 56) for k in range(CODES)])


def _decode(vector: np.ndarray, dim: int, height: float, directions: int, which: int) -> np.ndarray:
    """Numbers of all directions of a code whose inner product with the unit vector is ``height`` deviations
    or more, and at any rate of the best two."""
    turn, words = code(dim, directions, which)
    at = 0
    products = []
    turned = vector @ turn
    for w in words:
        products.append(w @ turned[at : at + w.shape[1]])
        at += w.shape[1]
    best = [np.partition(p, -2)[-2:] for p in products if len(p) > 1]
    second = sum(p.max() for p in products) - min((b[1] - b[0] for b in best), default=0.0)
    need = min(height / math.sqrt(dim), second - 1e-12)
    rest = np.cumsum([0.0, *(p.max() for p in reversed(products))])[::-1]  # rest[i]: the most that blocks i, i+1 ... add
    number, total = np.zeros(1, dtype=np.int64), np.zeros(1)
    for i, p in enumerate(products):
        order = np.argsort(-p)
        fits = np.searchsorted(-p[order], -(need - rest[i + 1] - total), side="right")  # of the best codewords, for each partial sum
        first = np.cumsum(fits) - fits
        which = np.arange(int(fits.sum())) - np.repeat(first, fits)
        number = np.repeat(number, fits) * len(p) + order[which]
        total = np.repeat(total, fits) + p[order[which]]
    return np.sort(number)


def _compare(rows: list[tuple], filter_: int, left: int, right: int, cosine: float) -> tuple[list, list]:
    """Links between the blocks ``left`` and ``right`` of a filter: copies linked by row, and a spanning forest."""
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    norm = np.sqrt((x * x).sum(axis=1))
    in_left = np.array([r[4] == left for r in rows])
    in_right = np.array([r[4] == right for r in rows])
    a, b = np.flatnonzero(in_left), np.flatnonzero(in_right)
    near = (x[a] @ x[b].T) / (norm[a][:, None] * norm[b][None, :]) >= cosine - 1e-9
    i, j = np.nonzero(near)
    i, j = a[i], b[j]
    if left == right:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return [], []
    exact = (x[i] * x[j]).sum(axis=1) / (norm[i] * norm[j]) >= cosine
    i, j = i[exact], j[exact]
    if not len(i):
        return [], []
    # a pair that also meets in a filter of a smaller number is counted there
    busy = np.unique(np.concatenate((i, j)))
    lists = [np.asarray(rows[k][3]) for k in busy]
    lists = [f[f < filter_] for f in lists]
    columns = np.unique(np.concatenate(lists)) if lists else np.zeros(0)
    first = np.ones(len(i), dtype=bool)
    if len(columns):
        member = np.zeros((len(busy), len(columns)), dtype=np.float32)
        for k, f in enumerate(lists):
            member[k, np.searchsorted(columns, f)] = 1
        at_i, at_j = np.searchsorted(busy, i), np.searchsorted(busy, j)
        if len(i) > len(busy):
            first = ~(member @ member.T > 0)[at_i, at_j]
        else:
            first = ~(member[at_i] * member[at_j]).any(axis=1)
    copies = np.array([r[2] for r in rows], dtype=np.int64)
    links = np.zeros(len(rows), dtype=np.int64)
    np.add.at(links, i[first], copies[j[first]])
    np.add.at(links, j[first], copies[i[first]])
    parent = list(range(len(rows)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    forest = []
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        rp, rq = root(p), root(q)
        if rp != rq:
            parent[rp] = rq
            forest.append((ids[p], ids[q]))
    return [(ids[k], int(links[k])) for k in np.flatnonzero(links)], forest


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id`` and ``kept``.

    Vectors link if their cosine in double precision is ``cosine`` or more. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    length with each other. Rows with equal vectors are copies of each other: they are filtered as one
    and each counts as a link of the others. A row without id takes no part; its component is null.
    """
    rows = only(vectors, id=id_col, vector=vector_col).select("id", F.col("vector").cast("array<double>").alias("vector"))
    good = (
        F.col("id").isNotNull()
        & F.coalesce(F.size("vector") > 0, F.lit(False))
        & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
        & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    )
    rows = rows.select("id", F.when(good, F.col("vector")).alias("vector"))
    whole = rows.where(F.col("vector").isNotNull())
    distinct = whole.groupBy("vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    n = whole.count()
    height, directions = plan(n, cosine)

    # single-precision components travel as such: half the bytes, the same numbers
    given = vectors.schema[vector_col].dataType
    number = np.dtype("<f4" if isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType) else "<f8")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, dims, lists = [], [], []
            for v in batch.column("vector"):
                x = np.asarray(v.values)
                data.append(x.astype(number).tobytes())
                dims.append(len(x))
                x = x / np.abs(x).max()  # so that squares neither overflow nor vanish
                lists.append(list_decode(x / np.linalg.norm(x), len(x), height, directions))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("copies"), pa.array(dims, pa.int32()), pa.array(data, pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
                ["rep", "copies", "dim", "data", "filters"],
            )

    scratch = Scratch()
    decoded = scratch.written(distinct.mapInArrow(decode, "rep long, copies long, dim int, data binary, filters array<long>"), "cap-filters")
    # filters are met by numbers alone; vectors follow only to filters that hold two or more
    each = decoded.select("rep", "dim", F.explode("filters").alias("filter"))
    full = each.groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    full = full.select("dim", "filter", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    met = each.join(full, ["dim", "filter"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    keys = ["dim", "filter", "left", "right"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
        held: list[tuple] = []
        key = None
        out: list[tuple] = []

        def close() -> None:
            if len(held) > 1:
                counts, forest = _compare(held, key[1], key[2], key[3], cosine)
                out.extend((a, None, n) for a, n in counts)
                out.extend((a, b, None) for a, b in forest)
            held.clear()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], schema.types[k]) for k in range(3)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            dim = batch.column("dim").to_pylist()
            values = [batch.column(c).to_pylist() for c in (*keys[1:], "rep", "copies", "block")]
            data, filters = batch.column("data"), batch.column("filters")
            for row in range(batch.num_rows):
                here = (dim[row], values[0][row], values[1][row], values[2][row])
                if here != key:
                    close()
                    key = here
                held.append((values[3][row], np.frombuffer(data[row].as_buffer(), number), values[4][row], np.asarray(filters[row].values), values[5][row]))
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    found = met.select(*keys, "rep", "block").join(decoded.drop("dim"), "rep").repartition(*keys).sortWithinPartitions(*keys)
    found = found.mapInArrow(compare, "a long, b long, links long").groupBy("a", "b").agg(F.sum("links").alias("links"))
    found = written(found, "cap-links")
    scratch.drop()
    label = components(found.where(F.col("b").isNotNull()).select("a", "b")).withColumnsRenamed({"node": "rep"})
    counts = found.where(F.col("b").isNull()).select(F.col("a").alias("rep"), "links")
    reps = distinct.join(counts, "rep", "left").join(label, "rep", "left")
    reps = reps.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where(F.col("vector").isNotNull()).join(reps, "vector", "inner").select("id", "n_links", "component_id")
    alone = rows.where(F.col("vector").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
