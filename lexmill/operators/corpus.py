"""Pages of transcribed books, conversations, citations in prose, greedy packing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .alike import alike, in_slices


def assess_pages(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The quality counts and warnings of every page; null texts count as empty.

    Counts come out of a generator of one row, so that ratio, warnings and status read them instead of counting again.
    """
    counts = F.struct(*(v.alias(k) for k, v in T.page_counts(F.coalesce("text", F.lit(""))).items()))
    counted = docs.select(F.col(id_col).alias("__id"), F.inline(F.array(counts)))
    return counted.select(F.col("__id").alias(id_col), *(v.alias(k) for k, v in T.page_quality().items()))


def ingest_counters(passages: DataFrame) -> DataFrame:
    """Per source: files, passages and duplicates by normal text within a file."""
    keys = ["source", "relative_path", "anchor", "normal"]
    marked = passages.withColumn("normal", T.normalize(F.col("text")))
    each = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("source").agg(F.countDistinct("relative_path").alias("files"), F.count(F.lit(1)).alias("passages"), F.sum(F.col("n") - 1).alias("duplicates"))


def duplicate_texts(passages: DataFrame) -> DataFrame:
    """Passages of equal normal text within a source: how many, and the first id, which wins at load."""
    return passages.groupBy("source", F.sha2(T.normalize(F.col("text")), 256).alias("text_key")).agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))


def sentences(text: Column) -> Column:
    """Sentences, cut after ., ! or ? and white space."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+", -1), lambda x: x != "")


def pack(parts: Column, most: int, gap: int) -> Column:
    """Greedy packing in order: parts joined while their lengths and gaps fit ``most``; a larger part stands alone."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))

    def add(acc: Column, x: Column) -> Column:
        grown = acc["size"] + F.when(F.size(acc["open"]) > 0, gap).otherwise(0) + F.length(x)
        fits = (F.size(acc["open"]) == 0) | (grown <= most)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
            F.when(fits, F.concat(acc["open"], F.array(x))).otherwise(F.array(x)).alias("open"),
            F.when(fits, grown).otherwise(F.length(x)).alias("size"),
        )

    return F.aggregate(parts, start, add, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def chunk_sentences(docs: DataFrame, most: int = 2400, id_col: str = "doc_id") -> DataFrame:
    """Chunks of whole sentences of ``most`` characters at most, numbered from 1; an overlong sentence is packed by words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            at, texts = [], []
            for i, parts in enumerate(batch.column("parts").to_pylist()):
                chunks = greedy([p for s in parts for p in (greedy(s.split(), most) if len(s) > most else [s])], most)
                at.append((i, len(chunks)))
                texts += chunks
            ids = batch.column("id").take(pa.array([i for i, n in at for _ in range(n)], pa.int64()))
            numbers = pa.array([k for _, n in at for k in range(1, n + 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, numbers, pa.array(texts, pa.string()), pa.array([len(c) for c in texts], pa.int64())], names=["id", "chunk", "text", "n_chars"])

    parts = docs.select(F.col(id_col).alias("id"), sentences(T.collapse(F.coalesce("text", F.lit("")))).alias("parts"))
    kind = parts.schema["id"].dataType.simpleString()
    return parts.mapInArrow(cut, f"id {kind}, chunk long, text string, n_chars long").withColumnRenamed("id", id_col)


def greedy(parts: list[str], most: int) -> list[str]:
    """Parts joined by blanks as long as they fit."""
    packed: list[list[str]] = []
    size = 0
    for part in parts:
        if packed and size + 1 + len(part) <= most:
            packed[-1].append(part)
            size += 1 + len(part)
        else:
            packed.append([part])
            size = len(part)
    return [" ".join(p) for p in packed]


def assemble_books(pages: DataFrame) -> DataFrame:
    """Complete pages of a book in order as one text, with the page counts of its manifest."""
    done = F.col("status") == "complete"
    return pages.groupBy("book").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(done, F.struct("page_number", "text")))), lambda x: F.concat(F.lit("<!-- page: "), x["page_number"].cast("string"), F.lit(" -->\n\n"), x["text"])), "\n\n").alias("text"),
        F.count_if(done).alias("completed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum(F.when(done, F.length("text")).otherwise(0)).alias("characters"), F.bool_and(F.col("status").isin("complete", "skipped")).alias("complete"),
    )


def page_context(pages: DataFrame, words: int = 200) -> DataFrame:
    """Each page with the last words of the page before it, if that one is there and complete. Only those words travel; of repeated pages the least counts."""
    last = F.filter(F.split("text", "\\s+"), lambda x: x != "")
    tail = F.array_join(F.when(F.size(last) > words, F.slice(last, -words, words)).otherwise(last), " ")
    before = pages.where("status = 'complete'").select("book", (F.col("page_number") + 1).alias("page_number"), tail.alias("context"))
    before = before.groupBy("book", "page_number").agg(F.min("context").alias("context"))
    return alike(pages, before, ["book", "page_number"], "left")


#: Role names and the role they stand for; any other is a tool.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "agentmessage": "assistant", "agent_message": "assistant", "system": "system"}


def role(name: Column) -> Column:
    mapped = F.lit("tool")
    for given, meant in ROLES.items():
        mapped = F.when(F.lower(F.trim(name)) == given, meant).otherwise(mapped)
    return mapped


def recent_messages(turns: DataFrame, most: int = 10, clip: int = 2400) -> DataFrame:
    """The last messages of each conversation, clipped."""
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("k", k).where(F.col("k") <= most).select("conv_id", "turn", role(F.col("role")).alias("role"), F.left("text", F.lit(clip)).alias("text"))


def conversation_titles(turns: DataFrame, most: int = 80) -> DataFrame:
    """The first line of a conversation's first user message, and its number of messages."""
    line = F.left(F.trim(F.split(F.col("text"), "\n", 2)[0]), F.lit(most))
    said = (role(F.col("role")) == "user") & (F.trim("text") != "")
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.min_by(F.when(said, line), F.when(said, F.col("turn"))), F.lit("New conversation")).alias("title"), F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn")
    )


def renderable(turns: DataFrame) -> DataFrame:
    """Messages to show: no tool output, nothing blank, no trace or JSON dump."""
    text = F.trim("text")
    return turns.where((role(F.col("role")) != "tool") & (text != "") & ~text.rlike(r"^(?:\{.*\}|\[\{.*\}\])$") & ~F.lower(text).rlike("^(?:tool|trace|debug|exec):"))


def history(conversations: DataFrame, most: int = 25) -> DataFrame:
    """Pinned conversations first, then the latest."""
    return conversations.orderBy(F.desc("pinned"), F.desc("updated_at"), "conv_id").limit(most)


CITED = r"\[\[([^\[\]:]+:)?([^\[\]#\s]+#[^\[\]\s]+)\]\]|(?<![\w/#])((?:[\w.-]+/)+[\w.-]+#[\w/-]+)"


def citations(rows: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Citations in prose, marked ``[[source:path#anchor]]`` or bare ``path#anchor``, in order of appearance."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(CITED), F.lit(0))
    each = rows.select(id_col, F.posexplode(found).alias("position", "cited"))
    bare = F.regexp_replace(F.regexp_replace("cited", r"^\[\[|\]\]$", ""), "[.,;:]+$", "")
    path = F.substring_index(bare, "#", 1)
    return each.select(id_col, "position", bare.alias("citation"), F.when(F.contains(path, F.lit(":")), F.substring_index(path, ":", 1)).alias("source"), F.substring_index(path, ":", -1).alias("path"), F.substring_index(bare, "#", -1).alias("anchor"))
