"""Exact top-k search by inner product with M-trees.

A tree holds a bounded number of vectors in pages. An entry of an inner page is a ball: a centre, a covering radius and
the distance to its parent's centre; an entry of a leaf page is a vector with its distance to the page's centre. With
``<q, x> = <q, c> + <q, x - c>`` a ball can give a query at most ``<q, c> + |q| r``; and as ``<q, c>`` is at most
``<q, p> + |q| d(c, p)`` for the parent's centre p, stored distances rule out entries, inner ones and vectors, before
any of their products are computed. Pages are taken best bound first until none can reach the k-th score.

How it is spread: vectors are dealt to the nearest of a bounded number of pivots and laid out by pivot and distance to it, with
the id behind, so that many copies of a vector still spread; each run of ``TREE`` of them becomes a tree, one row of a
written table. A query first asks the tree it lies in; then, in blocks, all trees whose root can still reach its k-th score.
What comes out of a tree are its best k for a query, and the ranking cuts them again before its shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, only, written

#: Vectors of a tree, entries of a page, queries that visit a tree together, pivots at most.
TREE, PAGE, QUERIES, PIVOTS = 4096, 256, 512, 512
#: Entries of an inner page.
FANOUT = 8
#: Whole numbers below this add up exactly in double precision.
EXACT = float(1 << 53)
#: Share by which bounds are widened, far above the rounding errors of products and norms.
SLACK = 1e-9
LONG = (-(1 << 63), (1 << 63) - 1)


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``id`` and ``x``, the components times ``scale`` rounded down, as doubles; one row per id.

    Rows without id, null vectors and those with null or non-finite components are left out; of rows with one id that
    with the least vector counts.
    """
    rows = only(vectors, id=id_col, vector=vector_col).select("id", F.col("vector").cast("array<double>").alias("vector"))
    fine = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    once = rows.where(F.col("id").isNotNull() & fine).groupBy("id").agg(F.min("vector").alias("vector"))
    return once.select("id", "vector").mapInArrow(lambda batches: _scaled(batches, scale), "id long, dim int, x binary")


def _scaled(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [np.floor(np.clip(np.asarray(v.values, dtype=np.float64) * scale, -1e300, 1e300)) for v in batch.column("vector")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").cast(pa.int64()), pa.array([len(v) for v in vectors], pa.int32()), pa.array([v.tobytes() for v in vectors], pa.binary())], ["id", "dim", "x"]
        )


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows without overflow."""
    if not x.size:
        return np.zeros(len(x))
    top = np.abs(x).max(axis=1)
    safe = np.where(top > 0, top, 1.0)
    return safe * np.sqrt(((x / safe[:, None]) ** 2).sum(axis=1)) * (top > 0)


def scores(x: np.ndarray, q: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of rows with rows, in double precision and as whole numbers held within 64 bits."""
    with np.errstate(over="ignore", invalid="ignore"):
        product = x @ q.T
    if exact:
        return product, product.astype(np.int64)
    big = lambda rows: np.array([[int(a) for a in row] for row in rows.tolist()], dtype=object).reshape(rows.shape)
    return product, np.clip(big(x) @ big(q).T, *LONG).astype(np.int64).reshape(product.shape)


def anything(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids that every vector comes before."""
    return np.full(n, LONG[0]), np.full(n, LONG[1])


class Tree:
    """An M-tree over the rows of ``x``: pages are (centre, radius, entries); entries are pages or, in leaves, rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x, self.size = ids, x, float(norms(x).max())
        self.most = float(np.abs(x).max()) if x.size else 0.0
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.parts: list[tuple[bool, np.ndarray, np.ndarray]] = []  # leaf?, rows or pages, their distances to the centre
        self._page(np.arange(len(ids)))
        self._lay_out()

    def _lay_out(self) -> None:
        """What a visit to a page needs, side by side: what an entry adds to the parent's distance, and centres or vectors."""
        radius, centre = np.array(self.radius), np.array(self.centre)
        self.reach = [gaps if leaf else gaps + radius[parts] for leaf, parts, gaps in self.parts]
        self.beside = [self.x[parts] if leaf else centre[parts] for leaf, parts, _ in self.parts]
        self.radii = radius

    def _page(self, rows: np.ndarray) -> int:
        x = self.x[rows]
        with np.errstate(over="ignore"):
            middle = x / len(x)
        centre = self.x[rows[int(norms(x - middle.sum(axis=0)).argmin())]]
        away = norms(x - centre)
        page = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(away.max()))
        self.parts.append((True, rows, away))
        if len(rows) > PAGE:
            groups = self._split(rows, x, away)
            below = np.array([self._page(g) for g in groups])
            gap = norms(np.array([self.centre[b] for b in below]) - centre)
            self.parts[page] = (False, below, gap)
        return page

    @staticmethod
    def _split(rows: np.ndarray, x: np.ndarray, away: np.ndarray) -> list[np.ndarray]:
        """Groups around vectors far from each other; where all are equal, runs of equal length."""
        first = int(away.argmax())
        least = norms(x - x[first])
        owner = np.zeros(len(x), dtype=np.int64)
        for k in range(1, FANOUT):
            far = int(least.argmax())
            if not least[far] > 0:
                break
            gap = norms(x - x[far])
            owner[gap < least] = k
            least = np.minimum(least, gap)
        groups = [rows[owner == k] for k in range(FANOUT)]
        groups = [g for g in groups if len(g)]
        return groups if len(groups) > 1 else np.array_split(rows, FANOUT)

    def top(self, q: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray) -> tuple[list[list[tuple[int, int]]], int]:
        """For each row of ``q`` its best ``k`` (score, id) of other ids that come before (kth, kth_id), and how many products it took.

        Pages are taken by the best bound that any of the queries has for them; a query goes on only into pages
        that can still give it something.
        """
        length = norms(q)
        pad = SLACK * length * (self.size + 1) + SLACK  # far above what rounding does to products and norms
        exact = self.most * float(np.abs(q).max(initial=0.0)) * q.shape[1] < EXACT
        worst, worst_id = kth.copy(), kth_id.copy()
        best: list[list[tuple[int, int]]] = [[] for _ in q]
        everyone = np.arange(len(q))
        pages = [(-np.inf, 0, everyone, self.centre[0] @ q.T)]
        count = len(q)
        while pages and len(q):
            bound, page, some, product = heapq.heappop(pages)
            floor = np.nextafter(worst.astype(np.float64), -np.inf)
            if -bound < floor.min():
                break
            leaf, parts, _ = self.parts[page]
            with np.errstate(over="ignore", invalid="ignore"):
                able = ~(self.reach[page][:, None] * length[some] + (product + pad[some]) < floor[some])  # by the stored distances alone
            rows, columns = able.any(axis=1), able.any(axis=0)
            able, some, parts = able[np.ix_(rows, columns)], some[columns], parts[rows]
            count += int(able.sum())
            product, score = scores(self.beside[page][rows], q[some], exact or not leaf)
            if leaf:
                ids = self.ids[parts]
                hit = able & (ids[:, None] != own[some]) & ((score > worst[some]) | ((score == worst[some]) & (ids[:, None] < worst_id[some])))
                for j in np.flatnonzero(hit.any(axis=0)).tolist():
                    at = int(some[j])
                    held = best[at] + list(zip(score[hit[:, j], j].tolist(), ids[hit[:, j]].tolist(), strict=True))
                    best[at] = held = heapq.nsmallest(k, held, key=lambda x: (-x[0], x[1]))
                    if len(held) == k:
                        worst[at], worst_id[at] = held[-1]
            else:
                with np.errstate(over="ignore", invalid="ignore"):
                    limit = np.nan_to_num(product + self.radii[parts][:, None] * length[some] + pad[some], nan=np.inf, posinf=np.inf, neginf=-np.inf)
                for i, p in enumerate(parts.tolist()):
                    on = able[i] & ~(limit[i] < floor[some])
                    if on.any():
                        heapq.heappush(pages, (-float(limit[i][on].max()), p, some[on], product[i][on]))
        return best, count

    def pack(self) -> dict:
        """The tree as columns of a row."""
        order, kinds, starts, gaps = [], [], [0], []
        for leaf, parts, away in self.parts:
            kinds.append(leaf)
            order.extend(parts.tolist())
            gaps.extend(away.tolist())
            starts.append(len(order))
        return {
            "ids": self.ids.astype("<i8").tobytes(), "vectors": self.x.astype("<f8").tobytes(), "centres": np.array(self.centre, dtype="<f8").tobytes(),
            "root": self.centre[0].tobytes(), "size": self.size, "radii": self.radius, "leaf": kinds, "starts": starts, "entries": order, "gaps": gaps,
        }

    @classmethod
    def unpack(cls, row: dict, dim: int) -> Tree:
        tree = cls.__new__(cls)
        tree.ids = np.frombuffer(row["ids"], dtype="<i8")
        tree.x = np.frombuffer(row["vectors"], dtype="<f8").reshape(len(tree.ids), dim)
        centres = np.frombuffer(row["centres"], dtype="<f8").reshape(len(row["radii"]), dim)
        tree.centre, tree.radius, tree.size = list(centres), row["radii"], row["size"]
        entries, gaps, starts = np.array(row["entries"], dtype=np.int64), np.array(row["gaps"]), row["starts"]
        tree.parts = [(leaf, entries[a:b], gaps[a:b]) for leaf, a, b in zip(row["leaf"], starts, starts[1:], strict=False)]
        tree.most = float(np.abs(tree.x).max()) if tree.x.size else 0.0
        tree._lay_out()
        return tree


PACKED = "ids binary, vectors binary, centres binary, root binary, size double, radii array<double>, leaf array<boolean>, starts array<int>, entries array<int>, gaps array<double>"
NAMES = ("ids", "vectors", "centres", "root", "size", "radii", "leaf", "starts", "entries", "gaps")
TREES = pa.schema(
    [("dim", pa.int32()), *((c, pa.binary()) for c in NAMES[:4]), ("size", pa.float64()), ("radii", pa.list_(pa.float64())), ("leaf", pa.list_(pa.bool_()))]
    + [(c, pa.list_(pa.int32())) for c in ("starts", "entries")] + [("gaps", pa.list_(pa.float64()))]
)


def build(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per tree: ``tree``, ``dim`` and its pages."""
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, n // TREE))).select("dim", "x").collect()  # bounded by PIVOTS
    pivots = {d: np.array([np.frombuffer(r["x"]) for r in sample if r["dim"] == d]) for d in {r["dim"] for r in sample}}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, away = [], []
            for dim, x in zip(batch.column("dim").to_pylist(), batch.column("x").to_pylist(), strict=True):
                gap = norms(pivots[dim] - np.frombuffer(x)) if dim in pivots else np.zeros(1)
                which.append(int(gap.argmin()))
                away.append(float(gap.min()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("dim"), batch.column("x"), pa.array(which, pa.int32()), pa.array(away, pa.float64())], ["id", "dim", "x", "pivot", "away"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def tree() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(r[1] for r in held)).reshape(len(held), key[0])
            made = Tree(np.array([r[0] for r in held], dtype=np.int64), x)
            held.clear()
            row = {"dim": key[0]} | made.pack()
            return pa.RecordBatch.from_pylist([row], TREES)

        for batch in batches:
            for id_, dim, x, pivot in zip(*(batch.column(c).to_pylist() for c in ("id", "dim", "x", "pivot")), strict=True):
                if held and ((dim, pivot) != key or len(held) == TREE):
                    yield tree()
                key = (dim, pivot)
                held.append((id_, x))
        if held:
            yield tree()

    dealt = rows.mapInArrow(deal, "id long, dim int, x binary, pivot int, away double")
    order = ("dim", "pivot", "away", "id")
    grown = dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(grow, f"dim int, {PACKED}")
    return scratch.written(grown.withColumn("tree", F.monotonically_increasing_id()), "metric-trees")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` rows of the largest inner product with each row whose id ``every`` divides.

    Vectors are scaled by ``scale`` and rounded down; scores are exact whole numbers, held at the ends of 64 bits where they pass them.
    Equal scores rank by the smaller id. Vectors of different length don't meet; null vectors, those with null or non-finite
    components and rows without id take no part; of rows that repeat an id that with the least vector counts. A query with fewer
    than ``k`` others has them all; an empty table gives none; other columns play no part.
    """
    scratch = Scratch()
    rows = scratch.written(whole(vectors, id_col, vector_col, scale), "metric-rows")
    trees = build(rows, scratch)
    is_query = lambda ids: ids % every == 0
    first_schema = "query_id long, dim int, q binary, tree long, kth long, kth_id long, found array<struct<vec_id:long,score:long>>"

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query asks the tree that it lies in."""
        found_type = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64())]))
        schema = pa.schema([("query_id", pa.int64()), ("dim", pa.int32()), ("q", pa.binary()), ("tree", pa.int64()), ("kth", pa.int64()), ("kth_id", pa.int64()), ("found", found_type)])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                tree = Tree.unpack(row, row["dim"])
                out = []
                asked = np.flatnonzero(is_query(tree.ids))
                found, _ = tree.top(tree.x[asked], tree.ids[asked], k, *anything(len(asked)))
                for at, best in zip(asked.tolist(), found, strict=True):
                    last = best[-1] if len(best) == k else anything(1)
                    out.append((int(tree.ids[at]), row["dim"], tree.x[at].tobytes(), row["tree"], int(last[0]), int(last[1]), [{"vec_id": b, "score": s} for s, b in best]))
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    first = scratch.written(trees.select("tree", "dim", *NAMES).mapInArrow(home, first_schema), "metric-home")
    blocks = scratch.written(first.select("dim", "query_id", "q", "tree", "kth", "kth_id").sortWithinPartitions("dim").mapInArrow(_blocks, BLOCKS).withColumn("block", F.monotonically_increasing_id()), "metric-blocks")
    # blocks of queries meet pages of roots; on go only queries to trees that can still reach their k-th score
    pages = scratch.written(trees.select("dim", "tree", "root", F.get("radii", F.lit(0)).alias("radius"), "size").sortWithinPartitions("dim").mapInArrow(_root_pages, ROOTS).withColumn("page", F.monotonically_increasing_id()), "metric-roots")
    numbers = pages.groupBy("dim").agg(F.collect_list("page").alias("pages"))
    pairs = blocks.join(numbers, "dim").withColumn("page", F.explode("pages")).drop("pages").join(pages.drop("dim"), "page")
    visits = pairs.mapInArrow(_reach, VISITS)
    met = visits.join(trees.drop("dim", "root"), "tree").mapInArrow(lambda batches: _visit(batches, k), "query_id long, vec_id long, score long")
    found = first.select("query_id", F.inline("found")).unionByName(met)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = written(found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "metric-top")
    scratch.drop()
    return out


BLOCKS = "dim int, query_ids binary, qs binary, homes binary, kths array<long>, kth_ids array<long>"
ROOTS = "dim int, trees binary, roots binary, radii binary, sizes binary"
VISITS = "tree long, dim int, query_ids binary, qs binary, kths array<long>, kth_ids array<long>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries of one dimension, packed into blocks."""
    schema = pa.schema([("dim", pa.int32()), *((c, pa.binary()) for c in ("query_ids", "qs", "homes")), *((c, pa.list_(pa.int64())) for c in ("kths", "kth_ids"))])
    for dim, rows in _runs(batches, ("query_id", "q", "tree", "kth", "kth_id"), QUERIES):
        ids, q, home, kth, kth_id = zip(*rows, strict=True)
        row = (dim, np.array(ids, dtype="<i8").tobytes(), b"".join(q), np.array(home, dtype="<i8").tobytes(), kth, kth_id)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema)


def _root_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots of one dimension, packed into pages."""
    schema = pa.schema([("dim", pa.int32()), *((c, pa.binary()) for c in ("trees", "roots", "radii", "sizes"))])
    for dim, rows in _runs(batches, ("tree", "root", "radius", "size"), TREE):
        trees, roots, radii, sizes = zip(*rows, strict=True)
        row = (dim, np.array(trees, dtype="<i8").tobytes(), b"".join(roots), np.array(radii, dtype="<f8").tobytes(), np.array(sizes, dtype="<f8").tobytes())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema)


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], most: int) -> Iterator[tuple[int, list[tuple]]]:
    """Up to ``most`` neighbouring rows of one dimension at a time."""
    held: list[tuple] = []
    key = None
    for batch in batches:
        for dim, *row in zip(batch.column("dim").to_pylist(), *(batch.column(c).to_pylist() for c in names), strict=True):
            if held and (dim != key or len(held) == most):
                yield key, held
                held = []
            key = dim
            held.append(tuple(row))
    if held:
        yield key, held


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each tree of a page of roots the queries of a block that it can still give something."""
    schema = pa.schema([("tree", pa.int64()), ("dim", pa.int32()), ("query_ids", pa.binary()), ("qs", pa.binary()), *((c, pa.list_(pa.int64())) for c in ("kths", "kth_ids"))])
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids, trees = np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["trees"], "<i8")
            q, roots = np.frombuffer(row["qs"]).reshape(len(ids), row["dim"]), np.frombuffer(row["roots"]).reshape(len(trees), row["dim"])
            length = norms(q)
            with np.errstate(over="ignore", invalid="ignore"):
                bound = roots @ q.T + (np.frombuffer(row["radii"])[:, None] + SLACK * (np.frombuffer(row["sizes"])[:, None] + 1)) * length + SLACK
            floor = np.nextafter(np.array(row["kths"], dtype=np.float64), -np.inf)
            able = ~(bound < floor) & (trees[:, None] != np.frombuffer(row["homes"], "<i8"))
            for t in np.flatnonzero(able.any(axis=1)).tolist():
                some = np.flatnonzero(able[t])
                made = (int(trees[t]), row["dim"], ids[some].tobytes(), q[some].tobytes(), [row["kths"][j] for j in some], [row["kth_ids"][j] for j in some])
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, made, strict=True))], schema)


def _visit(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Queries search the tree that they stand with."""
    number, tree = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if tree is None or row["tree"] != number:
                number, tree = row["tree"], Tree.unpack(row, row["dim"])
            ids = np.frombuffer(row["query_ids"], "<i8")
            q = np.frombuffer(row["qs"]).reshape(len(ids), row["dim"])
            found, _ = tree.top(q, ids, k, np.array(row["kths"], dtype=np.int64), np.array(row["kth_ids"], dtype=np.int64))
            out = [(query_id, other, score) for query_id, best in zip(ids.tolist(), found, strict=True) for score, other in best]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])
