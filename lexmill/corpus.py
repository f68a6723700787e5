"""A stored corpus: building its tables from files, and asking it questions."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .functions import text as T
from .operators import glossary, graph, numbering, postings, search
from .plans.query import QueryError, Scope, scope
from .sources import files, shared

GRAPH_TABLES = ("claims", "connections", "themes")


class Corpus:
    """Tables of a corpus under a folder. ``current`` names the build in use, so a failed build changes nothing."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _current(self) -> str:
        try:
            rows = self.spark.read.text(f"{self.root}/current").orderBy(F.desc("value")).limit(1).collect()
        except AnalysisException as missing:
            raise QueryError(f"no corpus at {self.root}; build it first") from missing
        return rows[0]["value"].split(" ")[1]

    def build(self, html: dict[str, str] | None = None, markdown: dict[str, str] | None = None, graph: str | None = None) -> DataFrame:
        """Reads folders (category: folder) and stores passages and vocabulary, and a graph's folder if there is one; returns the
        counters by source. The categories keep this order: those of HTML first."""
        parts = [files.html_paragraphs(files.texts(self.spark, folder, "*.html", "*.htm")).select(F.lit(c).alias("source"), "relative_path", "title", "book", "anchor", "ordinal", "text") for c, folder in (html or {}).items()]
        parts += [files.markdown_passages(files.texts(self.spark, folder, "*.md")).select(F.lit(c).alias("source"), "relative_path", "title", F.lit("").alias("book"), "anchor", "ordinal", "text") for c, folder in (markdown or {}).items()]
        if not parts:
            raise QueryError("nothing to read")
        return self.store(shared.staged(reduce(DataFrame.unionByName, parts), "parsed"), tuple(dict.fromkeys([*(html or {}), *(markdown or {})])), graph and files.graph_artifact(self.spark, graph))

    def store(self, passages: DataFrame, categories: tuple[str, ...] | None = None, graph_tables: tuple[DataFrame, ...] | None = None) -> DataFrame:
        """Stores passages (without ids), an inverted index of them and their vocabulary. Of equal texts under one anchor the first wins,
        told by their digests; ids follow source, path and ordinal without gaps."""
        build = f"{self.root}/{uuid.uuid4().hex}"
        first = search.first_of_equal(passages)
        order = [F.col("source"), F.lower("relative_path"), F.col("relative_path"), F.col("ordinal"), F.col("anchor")]
        numbered = numbering.positions(first, order, "__k", f"{build}/dealt").withColumn("id", F.col("__k") + 1).drop("__k")
        # rows come in the order of their ids, folder by folder, so that those of a result are a few pages of a file
        numbered.write.partitionBy("source").parquet(f"{build}/passages")
        shared.discard(self.spark, f"{build}/dealt")
        stored = self.spark.read.parquet(f"{build}/passages")
        postings.store(postings.postings(stored), f"{build}/postings")
        terms = self.spark.read.parquet(f"{build}/postings").groupBy("source", "term").agg(*(F.sum(c).alias(c) for c in ("document_frequency", "term_frequency")))
        terms.repartitionByRange("source", "term").sortWithinPartitions("source", "term").write.partitionBy("source").parquet(f"{build}/terms")
        names = categories or tuple(sorted(r["source"] for r in passages.select("source").distinct().collect()))  # a handful
        self.spark.createDataFrame(list(enumerate(names)), "position int, source string").coalesce(1).write.parquet(f"{build}/categories")
        for name, rows in zip(GRAPH_TABLES, graph_tables or (), strict=bool(graph_tables)):
            (graph.cited(rows) if name == "claims" else rows).write.parquet(f"{build}/{name}")
        self.spark.range(1).select(F.concat(F.date_format(F.current_timestamp(), "yyyyMMddHHmmssSSSSSS"), F.lit(" " + build.rpartition("/")[2]))).coalesce(1).write.mode("append").text(f"{self.root}/current")
        kept = self.passages().groupBy("source").agg(F.countDistinct("relative_path").alias("files"), F.count(F.lit(1)).alias("passages"))
        seen = passages.groupBy("source").agg(F.count(F.lit(1)).alias("seen"))
        return kept.join(seen, "source").withColumn("duplicates", F.col("seen") - F.col("passages")).drop("seen")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._current()}/{name}")

    def passages(self) -> DataFrame:
        return self._table("passages")

    def terms(self) -> DataFrame:
        return self._table("terms")

    def graph(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The stored claims, connections and themes."""
        try:
            return tuple(self._table(name) for name in GRAPH_TABLES)
        except AnalysisException as missing:
            raise QueryError("the corpus has no graph") from missing

    def scope(self, where: Scope) -> tuple[str, ...] | None:
        """A scope in the categories of this corpus, in the order of the build; ``default`` means the first two."""
        return scope(where, tuple(r["source"] for r in self._table("categories").orderBy("position").collect()))

    def postings(self) -> DataFrame:
        return self._table("postings")

    def search(self, query: str, where: Scope = "default", **options: object) -> DataFrame:
        """From the inverted index; the passages are read for the rows of the result alone."""
        return postings.search(self.postings(), self.terms(), self.passages(), query, self.scope(where), **options)

    def aggregate(self, queries: list[str], where: Scope = "default", **options: object) -> DataFrame:
        return search.fan_out(self.passages(), queries, self.scope(where), **options)

    def fuzzy(self, query: str, where: Scope = "default", per_token_limit: int = 3, max_distance: int | None = None, **options: int) -> DataFrame:
        """Uses the stored vocabulary rather than counting again."""
        found = self.scope(where)
        variants = search.corrections(search.roll_up(self.terms(), found), query, per_token_limit, max_distance)
        return search.fan_out(self.passages(), variants, found, **options)

    def passage(self, citation: str, context_passages: int = 4) -> DataFrame:
        return search.around(self.passages(), citation, context_passages)

    def stats(self) -> DataFrame:
        return search.stats(self.passages())

    def graph_stats(self) -> DataFrame:
        return graph.graph_stats(*self.graph(), self.passages())

    def glossary_lookup(self, path: str, term: str, limit: int = 10) -> DataFrame:
        return glossary.lookup(files.glossary(self.spark, path), term, limit)

    def glossary_search(self, path: str, query: str, limit: int = 10) -> DataFrame:
        return glossary.search(files.glossary(self.spark, path), query, limit)

    def connections(self, query: str | None = None, where: Scope = "all", claim: str | None = None, limit: int = 10) -> DataFrame:
        """Connections and themes that a query or a claim leads to, in the compact form."""
        if query is None and claim is None:
            raise QueryError("a query or a claim is needed")
        claims, connections, themes = self.graph()
        found = self.scope(where)
        if claim is not None:
            known = claims.where(F.col("claim_id") == claim).select("source").first()
            if known is None or (found is not None and known["source"] not in found):
                raise QueryError(f"no such claim in scope: {claim}")
        return graph.compact(graph.connections_of(connections, claims, query, found, claim, limit), graph.themes_of(themes, claims, query, found, claim, limit))
