"""Near-duplicate documents by Order MinHash.

A document's k-mers are its runs of three words, each labelled with how often it has occurred before.
A sketch takes the two k-mers of least hash and keeps them in text order, so that both content and
order decide whether two sketches agree. Documents that share a sketch are candidates, and a banded
word alignment verifies them: linked if edits <= (1 - 0.8) x words of the longer one. Texts of up to
50 words are also candidates if they share a segment (see ``segments``), which misses no link.

Documents with the same words are collapsed first. A bucket is the documents that share a sketch or
segment. Three passes settle all buckets:

1. Every member meets the member of least id (its hub); links make classes.
2. In buckets that still hold several classes, the members outside the largest class meet all members of
   other classes, in blocks of bounded size: a vector of word counts bounds the edits from below, and each
   member's most promising partner of a block is aligned. Links join classes.
3. Where classes remain apart, all pairs that the bound leaves are aligned. So no link of a bucket is lost.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import banded_distance
from .common import Scratch, by_slabs, filled, only, written
from .components import components
from .toxicity import pieces

#: Words of a k-mer, k-mers of a sketch, sketches of a document, least similarity of a link.
K, ELL, SKETCHES, SIMILARITY = 3, 2, 48, 0.8
#: Pairs whose longer text has at most so many words meet by segments too.
SHORT = 50
#: Members of a bucket that are compared with as many others at a time.
BLOCK = 4096
#: What a member is to a block.
COLUMN, ROW, BOTH = 1, 2, 3
#: Entries of the vector of word counts.
BINS = 512
#: Hash values of k-mers that are held at a time.
AT_ONCE = 1_000_000
#: Word hashes that a worker remembers.
WORDS_HELD = 400_000

_WORD = re.compile(r"\w+")
_SEEDS = np.array([xxhash.xxh64_intdigest(b"sketch", seed=j) for j in range(SKETCHES)], dtype=np.uint64)
#: Of each sketch an odd factor and a summand: the hash of an (already mixed) k-mer is factor * k-mer + summand.
_FACTORS = (_SEEDS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SUMMANDS = _SEEDS.astype(np.uint32)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > WORDS_HELD:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str, known: WordHashes) -> tuple[np.ndarray, bytes]:
    """The hash of each word of the lower-cased text, and a digest of these hashes in order.

    A text without words has the digest of the text itself.
    """
    parts = []
    for piece in pieces(text.lower()):
        words = _WORD.findall(piece)
        parts.append(np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)))
    hashes = parts[0] if len(parts) == 1 else np.concatenate(parts)
    exact = hashes.tobytes() or b"\n" + text.encode("utf-8", "surrogatepass")
    return hashes, hashlib.sha256(exact).digest()[:16]


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` words; none if there are fewer words."""
    count = max(0, len(words) - k + 1)
    run = np.zeros(count, dtype=np.uint64)
    for i in range(k):
        run = _mix(run * np.uint64(0x9E3779B97F4A7C15) + words[i : count + i])
    return run


def segments(words: np.ndarray, share: float) -> np.ndarray:
    """Keys of which any two texts of at most SHORT words share one if they are within the allowed edits.

    A text of n words that may have d edits is cut into d + 1 segments. In another text of at most n words
    within d edits one segment, say number i from 0, stands unchanged with at most i edits before it and d - i
    after it, which bounds its place. Each text gives the segments of its own length and the runs that can be
    segments of a longer text.
    """
    n, keys, by_length = len(words), [np.zeros(0, dtype=np.uint64)], {}
    for longer in range(max(n, 1), SHORT + 1):
        budget = int(share * longer + 1e-9)
        apart = longer - n
        if apart > budget:
            break
        for i in range(budget + 1 if budget else 0):  # without edits the texts are equal
            first, end = i * longer // (budget + 1), (i + 1) * longer // (budget + 1)
            low, high = first + max(-i, -apart - (budget - i)), first + min(i, budget - i - apart)
            if end - first not in by_length:
                by_length[end - first] = _runs(words, end - first)
            run = by_length[end - first][max(low, 0) : max(high + 1, 0)]
            keys.append(_mix(run + np.uint64((longer * (SHORT + 1) + i) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)))
    return np.unique(np.concatenate(keys)).view(np.int64)


def sketches(words: np.ndarray) -> np.ndarray:
    """The order-sensitive sketches of a document; none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kmer = _runs(words, min(K, n))
    order = np.argsort(kmer, kind="stable")
    ranked = kmer[order]
    new = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    seen = np.empty(len(kmer), dtype=np.uint64)  # how often the k-mer came before
    seen[order] = (np.arange(len(kmer)) - np.repeat(new, np.diff(np.append(new, len(kmer))))).astype(np.uint64)
    labelled = (_mix(kmer + seen * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty(SKETCHES, dtype=np.uint64)
    together = max(1, min(SKETCHES, AT_ONCE // len(labelled)))
    for j in range(0, SKETCHES, together):
        seeds = _SEEDS[j : j + together]
        h = labelled[None, :] * _FACTORS[j : j + together, None]
        h += _SUMMANDS[j : j + together, None]
        places = []
        for _ in range(min(ELL, len(labelled))):
            least = h.argmin(axis=1)
            h[np.arange(len(seeds)), least] = np.uint32(0xFFFFFFFF)
            places.append(least)
        value = seeds
        for at in np.sort(np.stack(places), axis=0):  # in text order
            value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + kmer[at])
        out[j : j + together] = value
    return out.view(np.int64)


def word_counts(words: np.ndarray) -> bytes:
    """How many words fall into each of BINS bins, 255 at most."""
    return np.minimum(np.bincount((words >> np.uint64(17)).astype(np.int64) % BINS, minlength=BINS), 255).astype(np.uint8).tobytes()


def least_edits(one: np.ndarray, n: int, others: np.ndarray, ns: np.ndarray) -> np.ndarray:
    """A lower bound of the edits between a text and others, from their word counts and lengths.

    An edit takes away one word at most and adds one at most; equal bins and cut counts only lower the bound.
    """
    apart = (np.maximum(others, one) - np.minimum(others, one)).sum(axis=1, dtype=np.int64)
    return (apart + np.abs(ns - n) + 1) // 2


def _sketched(rows: DataFrame, share: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for slab in by_slabs(batches, "text"):
            keys, counts, bins, signs, cuts = [], [], [], [], []
            for text in slab.column("text").to_pylist():
                words, key = word_hashes(text, known)
                keys.append(key)
                counts.append(len(words))
                bins.append(word_counts(words))
                signs.append(sketches(words).tobytes())
                cuts.append(segments(words, share).tobytes() if len(words) <= SHORT else b"")
            yield pa.RecordBatch.from_arrays([slab.column("id"), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(bins, pa.binary()), pa.array(signs, pa.binary()), pa.array(cuts, pa.binary())], ["id", "key", "n", "bins", "signs", "cuts"])

    return rows.mapInArrow(run, "id long, key binary, n long, bins binary, signs binary, cuts binary")


def _in_buckets(texts: DataFrame) -> DataFrame:
    """``bucket`` and ``id`` for each sketch and segment of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [a + b for a, b in zip(batch.column("signs").to_pylist(), batch.column("cuts").to_pylist(), strict=True)]
            each = np.fromiter((len(x) // 8 for x in lists), dtype=np.int64, count=len(lists))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(lists), dtype=np.int64)), pa.array(np.repeat(batch.column("id").to_numpy(), each))], ["bucket", "id"])

    return texts.select("id", "signs", "cuts").mapInArrow(run, "bucket long, id long")


def _words(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for slab in by_slabs(batches, "text"):
            lists = [word_hashes(text, known)[0].astype(np.uint32).view(np.int32) for text in slab.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([slab.column("id"), pa.array(lists, pa.list_(pa.int32()))], ["id", "words"])

    return rows.mapInArrow(run, "id long, words array<int>")


def _counted(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BINS)


def _promising(pairs: DataFrame, share: float) -> DataFrame:
    """Those of ``a``, ``b``, ``a_n``, ``b_n``, ``a_bins``, ``b_bins`` that their word counts don't keep apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, x_n, y_n = _counted(batch.column("a_bins")), _counted(batch.column("b_bins")), batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()
            near = least_edits(x, x_n, y, y_n) <= np.floor(share * np.maximum(x_n, y_n) + 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.select("a", "b", "a_n", "b_n", "a_bins", "b_bins").mapInArrow(run, "a long, b long")


def unshared(x: np.ndarray, y: np.ndarray) -> int:
    """How many words of the longer text the other one lacks; an edit mends one of them at most."""
    _, which = np.unique(np.concatenate((x, y)), return_inverse=True)
    bins = int(which.max(initial=0)) + 1
    shared = np.minimum(np.bincount(which[: len(x)], minlength=bins), np.bincount(which[len(x) :], minlength=bins)).sum()
    return max(len(x), len(y)) - int(shared)


def _verified(pairs: DataFrame, words: DataFrame, share: float) -> DataFrame:
    """``a``, ``b`` and ``near``: whether the edits are at most ``share`` of the longer text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, near = batch.column("x"), batch.column("y"), []
            for row in range(batch.num_rows):
                x, y = np.asarray(left[row].values), np.asarray(right[row].values)
                budget = int(share * max(len(x), len(y)) + 1e-9)
                least = unshared(x, y)
                near.append(least <= budget and banded_distance(x, y, budget, least) is not None)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_())], ["a", "b", "near"])

    both = pairs.join(words.select(F.col("id").alias("a"), F.col("words").alias("x")), "a").join(words.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, near boolean")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The runs of rows with equal keys; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.concat_batches(held)
        new = np.zeros(rows.num_rows - 1, dtype=bool)
        for key in keys:
            values = rows.column(key).to_numpy()
            new |= values[1:] != values[:-1]
        at = [0, *(np.flatnonzero(new) + 1).tolist()]
        for first, end in zip(at, at[1:], strict=False):
            yield rows.slice(first, end - first)
        held = [rows.slice(at[-1])]
    if held:
        yield held[0]


def _met(rows: DataFrame, share: float, best_only: bool) -> DataFrame:
    """Pairs ``a`` < ``b`` of different labels that word counts don't keep apart, of each block of each ``bucket``.

    With ``best_only`` each row of a block gives its most promising partner among the block's columns; ``more``
    tells whether it had others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            label, main = group.column("label").to_numpy(), group.column("main").to_numpy()
            if (label == label[0]).all():
                continue
            role, ids, n, bins, bucket = group.column("role").to_numpy(), group.column("id").to_numpy(), group.column("n").to_numpy(), _counted(group.column("bins")), group.column("bucket")[0].as_py()
            signs = np.frombuffer(b"".join(group.column("signs").to_pylist()), dtype=np.int64).reshape(-1, SKETCHES)
            right = role != ROW
            r_ids, r_n, r_label, r_bins, r_main, r_signs = ids[right], n[right], label[right], bins[right], label[right] == main[right], signs[right]
            a, b, more = [], [], []
            for i in np.flatnonzero(role != COLUMN):
                at = np.flatnonzero((r_label != label[i]) & (np.abs(r_n - n[i]) <= np.floor(share * np.maximum(r_n, n[i]) + 1e-9)))
                bound = least_edits(bins[i], n[i], r_bins[at], r_n[at])
                near = bound <= np.floor(share * np.maximum(r_n[at], n[i]) + 1e-9)
                at, bound = at[near], bound[near]
                common = r_signs[at] == signs[i]  # texts that share several sketches meet in the bucket of the first
                here = ~common.any(axis=1) | (signs[i][common.argmax(axis=1)] == bucket)
                if not best_only:
                    here &= r_main[at] | (r_ids[at] > ids[i])  # two outside the largest class meet both ways round
                at, bound = at[here], bound[here]
                if best_only and len(at) > 1:
                    at = at[[bound.argmin()]]
                    more.append(True)
                else:
                    more.extend([False] * len(at))
                a.extend(np.minimum(r_ids[at], ids[i]).tolist())
                b.extend(np.maximum(r_ids[at], ids[i]).tolist())
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([bucket] * len(a), pa.int64()), pa.array(more, pa.bool_())], ["a", "b", "bucket", "more"])

    keys = ["bucket", "row_block", "column_block"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "role", "id", "n", "label", "main", "bins", "signs").mapInArrow(run, "a long, b long, bucket long, more boolean")


def _open(members: DataFrame, nodes: DataFrame, label: DataFrame) -> DataFrame:
    """The members of buckets that hold several classes, dealt to blocks.

    The members outside a bucket's largest class are its rows, all its members are its columns; a row block
    and a column block meet in one group of some BLOCK rows each, however large the bucket is. A member comes
    once to each group that it belongs to.
    """
    marked = members.select("bucket", "id").join(label.select(F.col("node").alias("id"), "component"), "id", "left")
    marked = marked.select("bucket", "id", F.coalesce("component", "id").alias("label"))
    sizes = marked.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("total")).where("total > most")
    is_row = F.col("label") != F.col("main")
    row_blocks, column_blocks = F.ceil((F.col("total") - F.col("most")) / BLOCK).cast("int"), F.ceil(F.col("total") / BLOCK).cast("int")
    own_row, own_column = F.pmod(F.xxhash64("id"), row_blocks).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), column_blocks).cast("int")
    as_column = F.transform(F.sequence(F.lit(0), row_blocks - 1), lambda k: F.struct(k.alias("row_block"), own_column.alias("column_block"), F.when(is_row & (k == own_row), BOTH).otherwise(COLUMN).alias("role")))
    as_row = F.transform(F.sequence(F.lit(0), column_blocks - 1), lambda k: F.struct(own_row.alias("row_block"), k.alias("column_block"), F.lit(ROW).alias("role")))
    as_row = F.filter(as_row, lambda x: x["column_block"] != own_column)
    placed = marked.join(sizes, "bucket").join(nodes, "id")
    block = F.explode(F.when(is_row, F.concat(as_column, as_row)).otherwise(as_column)).alias("block")
    several = placed.where(F.col("total") > BLOCK).select("bucket", "id", "n", "label", "main", "bins", "signs", block).select("bucket", "id", "n", "label", "main", "bins", "signs", "block.*")
    single = placed.where(F.col("total") <= BLOCK).select("bucket", "id", "n", "label", "main", "bins", "signs", F.lit(0).alias("row_block"), F.lit(0).alias("column_block"), F.when(is_row, BOTH).otherwise(COLUMN).alias("role"))
    return single.union(several)


def relabelled(label: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``label`` (node, component) after further links: only classes that a link joins are looked at."""
    ends = links.where("near").select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(label.select(F.col("node").alias(end), F.col("component").alias(f"{end}_class")), end, "left").withColumn(f"{end}_class", F.coalesce(f"{end}_class", end))
    joins = scratch.written(ends.where("a_class <> b_class").select("a_class", "b_class").distinct(), "joins")
    if joins.isEmpty():
        return label
    merged = scratch.written(components(joins, "a_class", "b_class").select(F.col("node").alias("component"), F.col("component").alias("to")), "merged")
    nodes = label.union(merged.select("component", "component")).distinct()  # a class of one document had no row so far
    return scratch.written(nodes.join(merged, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: id, ``copy_of``, ``class_id`` and ``kept``.

    ``copy_of`` is the least id of the documents with the same words, ``class_id`` the least id that
    links reach, ``kept`` whether the id is that one. A null text counts as empty; texts without words
    are copies of each other only if they are equal, and link with nothing else. Texts of fewer than three words have
    one k-mer, the whole text. Very long texts are sketched and aligned whole. Rows that share an id count as one
    document. Rows without id get null classes and are kept. An empty table gives no rows. Further columns don't
    matter. Ids must be whole numbers.
    """
    if not 0 < similarity < 1:
        raise ValueError("the similarity must lie between 0 and 1")
    budget, scratch = 1 - similarity, Scratch()
    rows = only(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), filled(F.col("text")).alias("text"))
    sketched = scratch.written(_sketched(rows.where(F.col("id").isNotNull()), budget), "sketches")
    # texts with the same words count once
    distinct = scratch.written(sketched.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bins").alias("bins"), F.first("signs").alias("signs"), F.first("cuts").alias("cuts")), "distinct")
    buckets = _in_buckets(distinct)
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("bucket", "hub")
    members = scratch.written(buckets.join(shared, "bucket").where("id <> hub"), "members")  # all but the hubs
    met = members.select("id").union(members.select("hub")).distinct()
    nodes = scratch.written(distinct.select("id", "n", "bins", "signs").join(met, "id", "left_semi"), "nodes")

    def with_counts(pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(nodes.select(F.col("id").alias(end), F.col("n").alias(f"{end}_n"), F.col("bins").alias(f"{end}_bins")), end)
        return pairs

    to_hubs = scratch.written(_promising(with_counts(members.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()), budget), "pairs")
    # one row of each id has the words; rows that share an id can't both stand for it
    texts = rows.join(nodes.select("id"), "id", "left_semi")
    words = scratch.written(_words(texts).groupBy("id").agg(F.min("words").alias("words")), "words")
    known = scratch.written(_verified(to_hubs, words, budget), "aligned")
    label = scratch.written(components(known.where("near").select("a", "b")), "labels")
    for best_only in (True, False):
        tried = scratch.written(_met(_open(members, nodes, label), budget, best_only), "tried")
        pairs = tried.select("a", "b").distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
        found = scratch.written(_verified(pairs, words, budget), "aligned")
        label = relabelled(label, found, scratch)
        known = known.union(found)
        members = members.join(tried.where("more").select("bucket").distinct(), "bucket", "left_semi")

    classes = sketched.groupBy("key").agg(F.min("id").alias("rep")).join(label.select(F.col("node").alias("rep"), "component"), "rep", "left")
    classes = classes.select("key", "rep", F.coalesce("component", "rep").alias("class_id"))
    # rows that share an id count as one document
    told = sketched.select("id", "key").join(classes, "key").groupBy("id").agg(F.min("rep").alias("copy_of"), F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("times"))
    told = written(told, "classes")
    scratch.drop()
    told = told.withColumn("again", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select("id", "copy_of", "class_id")
    nameless = rows.where(F.col("id").isNull()).select("id", F.lit(None).cast("long").alias("copy_of"), F.lit(None).cast("long").alias("class_id"))
    out = told.union(nameless)
    return out.select(F.col("id").alias(id_col), "copy_of", "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class: that of the least id. All columns stay.

    Of rows that share its id the one of the least text stays (a null text counts as empty). Rows without id
    stay. An empty table gives no rows; texts without words are copies only of equal texts.
    """
    key, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = near_duplicates(docs, id_col, text_col, similarity).where(F.col("kept")).select(F.col(f"`{id_col}`").cast("long").alias("id"))
    kept = kept.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("id"), text.alias("text"))
    single = rows.join(kept.where("times = 1").select("id"), "id", "left_semi").select("row")
    several = kept.where("times > 1").select("id")
    if several.isEmpty():  # else the few repeated ids are settled by their texts
        chosen = single
    else:
        chosen = single.union(rows.join(several, "id", "left_semi").groupBy("id").agg(F.min_by("row", "text").alias("row")).select("row"))
    chosen = chosen.union(rows.where("id is null").select("row"))
    return chosen.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
