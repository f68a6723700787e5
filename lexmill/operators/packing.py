"""Fitting documents, passages and candidates into budgets, and checking what a model said about them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged
from .numbering import positions


def document_chunks(passages: DataFrame, most: int) -> DataFrame:
    """``chunk`` of each passage: documents are cut at passage boundaries so that a chunk's serialised passages fit ``most``.

    Documents are independent; within one the greedy choice is a fold over passage sizes, in order.
    """
    size = F.length(F.to_json(F.struct("passage_id", "anchor", "ordinal", "text")))

    def number(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("ordinal", kind="stable")
        chunk, held, out = 1, 0, []
        for n in batch["size"]:
            if held and held + n > most:
                chunk, held = chunk + 1, 0
            held += n
            out.append(chunk)
        return batch.assign(chunk=out)[["document_id", "passage_id", "chunk"]]

    sizes = passages.select("document_id", "passage_id", "ordinal", size.alias("size"))
    kind = {f.name: f.dataType.simpleString() for f in sizes.schema}
    numbered = sizes.groupBy("document_id").applyInPandas(number, f"document_id {kind['document_id']}, passage_id {kind['passage_id']}, chunk int")
    return passages.join(numbered, ["document_id", "passage_id"])


#: Chunks of a block; a batch holds far fewer, so what enters and leaves a block is a few places.
BLOCK = 4096


def _starts(documents: list, sizes: list[int], most: int, count: int) -> list[int]:
    """Where the batch after one that starts at each place would start: two ends that only move on."""
    out, end, held = [], 0, 0
    inside: set = set()
    for at in range(len(sizes)):
        while end < len(sizes) and (end == at or (held + sizes[end] <= most and end - at < count and documents[end] not in inside)):
            held += sizes[end]
            inside.add(documents[end])
            end += 1
        out.append(end)
        held -= sizes[at]
        inside.discard(documents[at])
    return out


def batches(chunks: DataFrame, most: int, count: int = 50, block: int = BLOCK) -> DataFrame:
    """``batch`` from 1 of each chunk (position, document_id, size): filled in order up to ``most`` and ``count`` chunks, a document once in each.

    The greedy choice depends on all chunks before it, but where a batch ends depends only on where it starts and on the next ``count`` chunks. So each block of
    chunks, with a look at the next few, becomes a map from the place at which a batch starts in it to the place at which one starts in
    the block after it, and the number of batches between. These maps are composed over ever longer stretches (a round for each doubling),
    which gives each block its first start and number; then the blocks are filled by themselves. The result is that of the fold over all chunks; no task holds more than a block.
    """
    block = max(block, count)
    rows = positions(chunks.select(F.col("position").cast("long").alias("position"), F.col("document_id").cast("string").alias("document_id"), F.col("size").cast("long").alias("size")), ["position", "document_id", "size"], "place")
    number = F.floor(F.col("place") / block)
    ahead = F.when((F.col("place") % block < count) & (number > 0), F.array(number, number - 1)).otherwise(F.array(number))
    dealt = staged(rows.withColumn("block", F.explode(ahead)).withColumn("own", F.floor(F.col("place") / block) == F.col("block")), "chunk-blocks")

    def mapped(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place", kind="stable")
        own = int(part["own"].sum())
        after = _starts(part["document_id"].tolist(), part["size"].tolist(), most, count)
        leave, many = [0] * own, [0] * own
        for at in range(own - 1, -1, -1):
            leave[at], many[at] = (after[at] - own, 1) if after[at] >= own else (leave[after[at]], 1 + many[after[at]])
        return pd.DataFrame({"block": [int(part["block"].iloc[0])], "leave": [leave[:count]], "many": [many[:count]]})

    maps = staged(dealt.groupBy("block").applyInPandas(mapped, "block long, leave array<long>, many array<long>"), "chunk-maps")
    last, reach = maps.agg(F.max("block")).first()[0], 1
    while last is not None and reach <= last:
        before = maps.select((F.col("block") + reach).alias("block"), F.col("leave").alias("enter"), F.col("many").alias("earlier"))
        both = maps.join(before, "block", "left")
        maps = staged(
            both.select(
                "block",
                F.when(F.col("enter").isNull(), F.col("leave")).otherwise(F.transform("enter", lambda e: F.get("leave", e.cast("int")))).alias("leave"),
                F.when(F.col("enter").isNull(), F.col("many")).otherwise(F.transform("enter", lambda e, k: F.get("earlier", k) + F.coalesce(F.get("many", e.cast("int")), F.lit(0)))).alias("many"),
            ),
            "chunk-maps",
        )
        reach *= 2
    entries = maps.select((F.col("block") + 1).alias("block"), F.get("leave", F.lit(0)).alias("enter"), F.get("many", F.lit(0)).alias("earlier"))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place", kind="stable")
        after = _starts(part["document_id"].tolist(), part["size"].tolist(), most, count)
        at, batch = (0, 0) if pd.isna(part["enter"].iloc[0]) else (int(part["enter"].iloc[0]), int(part["earlier"].iloc[0]))
        out = [batch] * min(at, len(part))  # these belong to the last batch of the block before
        while at < len(part):
            batch += 1
            out += [batch] * (after[at] - at)
            at = after[at]
        return part.assign(batch=out)[part["own"].to_numpy()][["position", "document_id", "size", "batch"]]

    started = dealt.join(entries, "block", "left")
    return started.groupBy("block").applyInPandas(fill, "position long, document_id string, size long, batch long")


# What a finding may ask for, how sure it may be, and how long its reason may be.
ACTIONS, CONFIDENCES, REASON_CLIP = ("remove_ordinary_english",), ("high", "medium", "low"), 1600


def audit_findings(findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Findings (position, candidate_number, action, reason, confidence) with the first ``warning`` against each, or none.

    The first acceptable finding of a candidate counts; later ones repeat it.
    """
    known = candidates.select("candidate_number", F.lit(True).alias("known")).distinct()
    rows = findings.join(known, "candidate_number", "left")
    flaw = (
        F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown action")
        .when(F.trim(F.coalesce("reason", F.lit(""))) == "", "no reason")
        .when(~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False)), "unknown confidence")
    )
    rows = rows.withColumn("flaw", flaw)
    before = Window.partitionBy("candidate_number").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.max(F.col("flaw").isNull()).over(before), F.lit(False))
    warning = F.when(F.col("known").isNull(), "unknown candidate").when(taken, "repeated candidate").otherwise(F.col("flaw"))
    return rows.withColumn("warning", warning).withColumn("reason", F.left(F.trim("reason"), F.lit(REASON_CLIP))).drop("flaw", "known")


def action_counts(audited: DataFrame) -> DataFrame:
    """How many accepted findings ask for which action."""
    return audited.where("warning is null").groupBy("action").agg(F.count(F.lit(1)).alias("findings"))


def compact_evidence(rows: DataFrame, most: int = 18, clip: int = 1600, queries: int = 6) -> DataFrame:
    """The first rows of a result with an id and a snippet, clipped, without local paths."""
    hidden = [c for c in ("source_path", "absolute_path", "source_absolute_path") if c in rows.columns]
    kept = rows.drop(*hidden).where(F.col("id").isNotNull() & (F.trim("snippet") != "")).withColumn("snippet", F.left("snippet", F.lit(clip)))
    if "matched_queries" in rows.columns:
        kept = kept.withColumn("matched_queries", F.slice("matched_queries", 1, queries))
    return kept.orderBy("rank").limit(most)


def first_filled(*names: str) -> Column:
    """The first of several columns that holds more than blanks."""
    return F.coalesce(*(F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names))


def upsert(stored: DataFrame, fresh: DataFrame, key: str = "id", keep: tuple[str, ...] = ("pinned",)) -> DataFrame:
    """Fresh rows replace stored ones of their key, but keep the stored values of some columns."""
    old = stored.select(key, *(F.col(c).alias(f"__{c}") for c in keep))
    merged = fresh.join(old, key, "left").withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in keep}).drop(*(f"__{c}" for c in keep))
    return stored.join(fresh.select(key), key, "left_anti").unionByName(merged.select(*stored.columns))


def resume(pages: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Pages still to do: those without a finished checkpoint of the same content."""
    done = checkpoints.where(F.col("status").isin("complete", "skipped")).select("page_number", "source_sha256").distinct()
    return pages.join(done, ["page_number", "source_sha256"], "left_anti")


def usage_totals(rows: DataFrame, usage: str = "usage") -> DataFrame:
    """Sums of a map of counters over all rows."""
    return rows.select(F.explode(usage).alias("counter", "n")).groupBy("counter").agg(F.sum("n").alias("total"))
