"""A stored inverted index: which passages have a term, and at which places, so that a search reads its terms' part of it and no texts.

A row of it is a block: the passages of one source that were read together and have the term, as arrays. That is a small part of the rows that
one for each term and passage would make, and blocks are what is shuffled, sorted and stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.query import Scope, SearchPlan, parse, scope, within
from ..sources.shared import staged
from . import search as ranked

#: Folders of a stored index; a term is in one of them.
BUCKETS = 64
#: Passages of the rarest term up to which their ids are sent to all tasks that read the other terms' lists.
FEW = 1_000_000
#: Bytes of text that make blocks together; a longer text makes its own.
AT_ONCE = 8_000_000
#: ``F_at``: the places of all of a block's passages in field F, one passage after the other; ``F_end``: where those of each passage end there (empty if no passage has any).
LISTS = tuple(f"{f}_{part}" for f in ranked.FIELDS for part in ("end", "at"))
SCHEMA = "term string, source string, document_frequency int, term_frequency int, ids array<long>, " + ", ".join(f"{c} array<int>" for c in LISTS)


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``AT_ONCE`` bytes of text, or one row."""
    ends = np.cumsum(sum(pc.binary_length(batch.column(f)).to_numpy(zero_copy_only=False).astype(np.int64) for f in ranked.FIELDS))
    start = 0
    while start < batch.num_rows:
        held = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, held + AT_ONCE, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of spaced texts, the text each is in and its place there."""
    parts = pc.split_pattern(texts, " ")
    flat, row = parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    real = pc.not_equal(flat, "")
    flat, row = flat.filter(real), row[real.to_numpy(zero_copy_only=False)]
    count = np.bincount(row, minlength=len(texts))
    return flat, row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The blocks of a part: its words sorted by source, term, passage, field and place, and cut where source or term change."""
    found = [_words(batch.column(f)) for f in ranked.FIELDS]
    words = pa.concat_arrays([w for w, _, _ in found]).dictionary_encode()
    row, place = (np.concatenate([x[k] for x in found]) for k in (1, 2))
    field = np.repeat(np.arange(len(found), dtype=np.int8), [len(w) for w, _, _ in found])
    sources = batch.column("source").dictionary_encode("encode")
    group = sources.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * len(words.dictionary) + words.indices.to_numpy(zero_copy_only=False)
    key = group * batch.num_rows + row
    order = np.argsort(key, kind="stable")  # words come by field and place
    key, field, place = key[order], field[order], place[order].astype(np.int32)
    new = np.flatnonzero(np.diff(key, prepend=-1))  # where a passage's places begin
    group = key[new] // batch.num_rows
    first = np.flatnonzero(np.diff(group, prepend=-1))  # of these, where a block begins
    starts = np.append(first, len(new))
    size = np.diff(starts)
    of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key))))
    lists = []
    for k in range(len(found)):
        mine = field == k
        upto = np.append(0, np.cumsum(np.bincount(of[mine], minlength=len(new))))
        has = np.repeat(upto[starts[1:]] > upto[first], size)
        end = (upto[1:] - np.repeat(upto[first], size))[has]
        offsets = np.append(0, np.cumsum(has))[starts]
        lists += [(offsets, end), (upto[starts], place[mine])]
    term = pa.array(group[first] % len(words.dictionary)) if len(first) else pa.array([], pa.int64())
    source = pa.array(group[first] // len(words.dictionary)) if len(first) else pa.array([], pa.int64())
    listed = lambda offsets, values, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
    columns = [words.dictionary.take(term), sources.dictionary.take(source), pa.array(size, pa.int32()), pa.array(np.diff(np.append(new, len(key))[starts]), pa.int32())]
    columns += [listed(starts, batch.column("id").to_numpy(zero_copy_only=False)[key[new] % batch.num_rows], pa.int64())]
    columns += [listed(offsets, values, pa.int32()) for offsets, values in lists]
    return pa.RecordBatch.from_arrays(columns, names=["term", "source", "document_frequency", "term_frequency", "ids", *LISTS])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from map(_blocks, _cut(batch))


def postings(passages: DataFrame) -> DataFrame:
    """Blocks of a term and source: how many passages and places they hold, the passages and their places in title, book and text."""
    words = ranked.with_words(passages).select("id", "source", *(F.col(f"{f}_words").alias(f) for f in ranked.FIELDS))
    return words.mapInArrow(_listed, SCHEMA)


def store(rows: DataFrame, path: str) -> None:
    """Writes postings in folders by hashed term, sorted by term and id in each file; a folder, or a frequent term's list, spreads over files as it grows.

    Rows are rebalanced, not dealt by ranges, for which the blocks would be made once more to draw a sample of them.
    """
    order = ("bucket", "term", F.get("ids", F.lit(0)))
    rows.withColumn("bucket", bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions(*order).write.partitionBy("bucket").parquet(path)


def of_term(index: DataFrame, term: str, places: bool = True) -> DataFrame:
    """A term's list: the bucket is a folder, the term a range of its files. ``id``, ``source``, for each field how often (``F_n``), and where (``F_at``) if asked."""
    number = index.sparkSession.range(1).select(bucket(F.lit(term))).first()[0]
    rows = index.where((F.col("bucket") == number) & (F.col("term") == term))
    upto = lambda f, k: F.coalesce(F.get(f"{f}_end", k), F.lit(0))
    often = lambda f, k: upto(f, k) - upto(f, k - 1)

    def one(id_: Column, k: Column) -> Column:
        where = [F.slice(f"{f}_at", upto(f, k - 1) + 1, often(f, k)).alias(f"{f}_at") for f in ranked.FIELDS if places]
        return F.struct(id_.alias("id"), *(often(f, k).alias(f"{f}_n") for f in ranked.FIELDS), *where)

    return rows.select("source", F.inline(F.transform("ids", one)))


def _phrase(run: tuple[str, ...], field: str, names: dict[str, str]) -> Column:
    """How often the words stand one after the other in a field."""

    def shifted(word: str, by: int) -> Column:
        return F.transform(f"{names[word]}_{field}_at", lambda at: at - by)

    met = shifted(run[0], 0)
    for k, word in enumerate(run[1:], 1):
        met = F.array_intersect(met, shifted(word, k))
    return F.size(met)


def hits(index: DataFrame, frequencies: DataFrame, plan: SearchPlan, where: Scope = "all") -> DataFrame:
    """``id``, ``score`` and ``match_count`` of the passages that have all terms and phrases.

    Lists are joined from the rarest on (``frequencies``: ``term``, ``document_frequency``); where the rarest is known to
    be short, its ids go to the tasks that read the others, and only what they have in common is joined.
    """
    spark = index.sparkSession
    known = {r["term"]: r["n"] for r in frequencies.where(F.col("term").isin(*plan.words)).groupBy("term").agg(F.sum("document_frequency").alias("n")).collect()}  # a row a word
    empty = spark.range(0).select("id", F.col("id").alias("score"), F.col("id").alias("match_count"))
    if len(known) < len(plan.words):
        return empty
    found = scope(where)
    names = {w: f"t{k}" for k, w in enumerate(sorted(plan.words, key=lambda w: (known[w], w)))}
    kept = [f"{f}_{part}" for f in ranked.FIELDS for part in (("n", "at") if plan.phrases else ("n",))]
    chosen = index if found is None else index.where(F.col("source").isin(*found))
    lists = {name: of_term(chosen, word, bool(plan.phrases)) for word, name in names.items()}
    met = lists["t0"].select("id", *(F.col(c).alias(f"t0_{c}") for c in kept))
    few = known[next(iter(names))] <= FEW
    for name, rows in list(lists.items())[1:]:
        if few:
            rows = rows.join(F.broadcast(lists["t0"].select("id")), "id", "left_semi")
        met = met.join(rows.select("id", *(F.col(c).alias(f"{name}_{c}") for c in kept)), "id")
    count = lambda w, f: F.col(f"{names[w]}_{f}_n")
    total = ranked.total(count(w, f) for w in plan.words for f in ranked.FIELDS)
    runs = [ranked.total(_phrase(p, f, names) for f in ranked.FIELDS) for p in plan.phrases]
    for run in runs:
        met = met.where(run > 0)
    points = ranked.total(count(w, f) * (ranked.WEIGHTS[f] + 1) for w in plan.words for f in ranked.FIELDS)
    return met.select("id", (ranked.total(runs) * ranked.PHRASE_WEIGHT + points).cast("long").alias("score"), total.cast("long").alias("match_count"))


def search(index: DataFrame, frequencies: DataFrame, passages: DataFrame, query: str, where: Scope = "default", limit: int = 10, context: int | None = 220, book: str | None = None, title: str | None = None) -> DataFrame:
    """What ``operators.search.search`` gives, from the index: texts are read for the rows of the result alone, found by their ids.

    Of the passages only paths and anchors are read besides, which decide between equal scores, and book and title if there is a filter on them.
    """
    within(limit=limit, context=context or 0)
    plan = parse(query)
    found = hits(index, frequencies, plan, where)
    if book or title:
        found = found.join(ranked.in_scope(passages.select("id", "source", "book", "title"), where, book, title).select("id"), "id", "left_semi")
    found = staged(found, "hits")
    least = found.orderBy(F.desc("score")).limit(limit).agg(F.min("score")).first()[0]  # one number
    tied = found.where(F.col("score") >= (0 if least is None else least))
    if found.count() <= FEW:
        tied = F.broadcast(tied)
    named = passages.select("id", "relative_path", "anchor").join(tied, "id")
    best = named.orderBy(*ranked.ordering(F.desc("score"))).limit(limit).select("id", "score", "match_count").collect()  # at most ``limit`` rows of numbers
    ids = [r["id"] for r in best] or [None]
    told = index.sparkSession.createDataFrame([(k, r["id"], r["score"], r["match_count"]) for k, r in enumerate(best, 1)], "rank int, id long, score long, match_count long")
    rows = passages.where(F.col("id").isin(*ids)).join(F.broadcast(told), "id")
    columns = ["rank", "id", "score", "source", "title", F.nullif("book", F.lit("")).alias("book"), "relative_path", "anchor", ranked.citation().alias("citation"), "match_count", F.lit(bool(plan.phrases)).alias("phrase_match")]
    if context is None:
        return rows.select(*columns).orderBy("rank")
    return rows.withColumn("cut", ranked.snippets(context, plan)).select(*columns, "cut.*").orderBy("rank")
