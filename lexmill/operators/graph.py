"""Claims with quotes, their validation, and the graph of connections and themes over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.query import Scope, SearchPlan, parse, scope, within
from ..sources.shared import staged
from .numbering import positions

# What a claim and a connection may say of themselves, and how long their texts may be.
CLAIM_TYPES = ("definition", "proposition", "causal_claim", "prescription", "distinction", "classification", "historical_claim", "unique_concept", "qualification")
MODALITIES = ("asserted", "recommended", "reported", "hypothetical", "conditional", "questioned", "denied")
ATTRIBUTIONS = ("primary_speaker", "author", "quoted_person", "narrator", "unclear")
CONNECTION_TYPES = ("supports", "extends", "qualifies", "contrasts", "conceptual_parallel", "possible_contradiction")
CONFIDENCES = ("high", "medium", "tentative")
SUMMARY_CLIP, EXPLANATION_CLIP, LABEL_CLIP = 1200, 3000, 300
MOST_PER_DOCUMENT, MOST_CLAIMS = 15, 5


def evidence(text: Column) -> Column:
    """The form in which quotes are compared: NFKC, case folded, straight quotes, single blanks."""
    return T.collapse(F.translate(T.compatible(text), "\u2018\u2019\u201c\u201d", "''\"\""))


def claim_id(document: Column, passage: Column, quote: Column) -> Column:
    return F.concat(document, F.lit("#"), passage, F.lit("#claim-"), F.left(F.sha2(F.concat_ws("|", document, passage, evidence(quote)), 256), F.lit(16)))


def validate(items: DataFrame, passages: DataFrame, per_document: int = MOST_PER_DOCUMENT, total: int | None = None) -> DataFrame:
    """Items with the first ``reason`` against them, or none: unknown passage, no quote, quote not in the passage,
    repeated evidence, too many of a document, too many in all.

    ``items``: position, document_id, passage_id, statement, quote. ``passages``: document_id, passage_id, text.
    Caps apply in item order to valid first items; counters move only where an item is accepted, so row numbers after the other checks say the same.
    """
    cited = items.select("document_id", "passage_id").distinct()
    known = passages.select("document_id", "passage_id", "text").join(cited, ["document_id", "passage_id"], "left_semi").select("document_id", "passage_id", evidence(F.col("text")).alias("passage_text"))
    quote = evidence(F.coalesce("quote", F.lit("")))
    rows = items.withColumn("evidence", quote).join(known, ["document_id", "passage_id"], "left")
    reason = (
        F.when(F.trim(F.coalesce("statement", F.lit(""))) == "", "no statement")
        .when(F.col("evidence") == "", "no quote")
        .when(F.col("passage_text").isNull(), "unknown passage")
        .when(~F.contains("passage_text", "evidence"), "quote not in passage")
    )
    rows = rows.withColumn("reason", reason).drop("passage_text")
    valid = F.col("reason").isNull()
    again = F.row_number().over(Window.partitionBy(valid, "document_id", "passage_id", "evidence").orderBy("position"))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(again > 1, "repeated evidence")))
    nth = F.row_number().over(Window.partitionBy(F.col("reason").isNull(), "document_id").orderBy("position"))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(nth > per_document, "too many of the document")))
    if total is not None:
        accepted = rows.where("reason is null").orderBy("position").limit(total).select("position", F.lit(True).alias("in"))
        rows = rows.join(accepted, "position", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("in").isNull(), "too many in all"))).drop("in")
    return rows.drop("evidence").withColumn("claim_id", F.when(F.col("reason").isNull(), claim_id(F.col("document_id"), F.col("passage_id"), F.col("quote"))))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with their 1-based rank by ``position`` (each once)."""
    return positions(rows, ["position"], "__place").withColumn(name, F.col("__place") + 1).drop("__place")


def _judge(rows: DataFrame, claims: DataFrame, early: Column, late: Column, repeated: list[Column], most: int | None) -> DataFrame:
    """``rows`` with distinct ``claim_ids`` in order and the first ``reason`` against each; ``early`` and ``late`` come before and after the tests of claims."""
    size = F.coalesce(F.size("claim_ids"), F.lit(0))
    each = rows.select("position", F.explode("claim_ids").alias("claim_id")).join(claims.select("claim_id", F.lit(1).alias("known")).distinct(), "claim_id", "left")
    told = each.groupBy("position").agg(F.count(F.lit(1)).alias("ids"), F.count("known").alias("known"), F.countDistinct("claim_id").alias("unique"), F.countDistinct(F.substring_index("claim_id", "#", 1)).alias("documents"))
    reason = F.coalesce(
        early,
        F.when(size < 2, "fewer than two claims"),
        F.when(size > most, "too many claims") if most else F.lit(None),
        F.when(F.coalesce("known", F.lit(0)) < size, "unknown claim"),
        F.when(F.col("unique") < 2, "only one unique claim"),
        F.when(F.col("documents") < 2, "within one document"),
        late,
    )
    rows = rows.join(told, "position", "left").withColumn("reason", reason).withColumn("claim_ids", F.array_distinct("claim_ids")).drop("ids", "known", "unique", "documents")
    nth = F.row_number().over(Window.partitionBy(F.col("reason").isNull(), *repeated, F.array_sort("claim_ids")).orderBy("position"))
    return rows.withColumn("reason", F.coalesce("reason", F.when(nth > 1, "repeats an earlier one")))


def judge_connections(connections: DataFrame, claims: DataFrame, most: int | None = None) -> DataFrame:
    """Each connection with the first ``reason`` against it, or none.

    ``connections``: position, type, confidence, summary, explanation, claim_ids; a null or blank text counts as missing.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    early = F.when(~F.coalesce(F.col("type").isin(*CONNECTION_TYPES), F.lit(False)), "unsupported type")
    late = F.when(blank("summary"), "no summary").when(blank("explanation"), "no explanation").when(~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False)), "unsupported confidence")
    return _judge(connections, claims, early, late, [F.col("type")], most)


def validate_connections(connections: DataFrame, claims: DataFrame, most: int | None = MOST_CLAIMS) -> DataFrame:
    """The accepted connections, clipped and numbered in order."""
    good = judge_connections(connections, claims, most).where("reason is null").drop("reason")
    good = good.withColumns({"summary": F.left(F.trim("summary"), F.lit(SUMMARY_CLIP)), "explanation": F.left(F.trim("explanation"), F.lit(EXPLANATION_CLIP))})
    return numbered(good, "k").withColumn("connection_id", F.format_string("conn-%03d", "k")).drop("k")


def judge_themes(themes: DataFrame, claims: DataFrame) -> DataFrame:
    """Each theme (position, label, summary, claim_ids) with the first ``reason`` against it, or none."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return _judge(themes, claims, F.when(blank("label"), "no label"), F.when(blank("summary"), "no summary"), [F.lower(F.trim("label"))], None)


def validate_themes(themes: DataFrame, claims: DataFrame) -> DataFrame:
    """The accepted themes, clipped and numbered in order."""
    good = judge_themes(themes, claims).where("reason is null").drop("reason")
    good = good.withColumns({"label": F.left(F.trim("label"), F.lit(LABEL_CLIP)), "summary": F.left(F.trim("summary"), F.lit(SUMMARY_CLIP))})
    return numbered(good, "k").withColumn("theme_id", F.format_string("theme-%03d", "k")).drop("k")


def counters(judged: DataFrame) -> DataFrame:
    """``reason`` (null: accepted) and how many rows have it."""
    return judged.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def claims_in_graph(*edges: DataFrame) -> DataFrame:
    """How many different claims connections and themes name together."""
    every = edges[0].select("claim_id")
    for more in edges[1:]:
        every = every.unionAll(more.select("claim_id"))
    return every.agg(F.countDistinct("claim_id").alias("claims"))


def link_sources(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Claims with the passage they cite: by source, path and anchor, else by the number in ``pNNNN``."""
    by_anchor = passages.withColumn("k", F.row_number().over(Window.partitionBy("source", "relative_path", "anchor").orderBy("ordinal", "id"))).where("k = 1")
    by_number = passages.withColumn("k", F.row_number().over(Window.partitionBy("source", "relative_path", "ordinal").orderBy("id"))).where("k = 1")
    pick = lambda rows, name: rows.select("source", F.col("relative_path").alias("path"), *(["anchor"] if name == "exact" else ["ordinal"]), F.struct("id", "title", "text").alias(name))
    number = F.regexp_extract("passage_id", "^p([0-9]{4,})$", 1)
    rows = claims.withColumn("ordinal", F.when(number != "", number.cast("int") - 1))
    found = rows.join(pick(by_anchor, "exact"), ["source", "path", "anchor"], "left").join(pick(by_number, "numbered"), ["source", "path", "ordinal"], "left")
    return found.withColumn("passage", F.coalesce("exact", "numbered")).drop("exact", "numbered", "ordinal")


def related(rows: DataFrame, id_col: str, fields: list[str], claims: DataFrame, query: str | None = None, where: Scope = "all", claim: str | None = None, limit: int = 10) -> DataFrame:
    """Connections or themes (``id_col``, ``fields``, ``claim_ids``) whose claims are all known and in scope, by text score
    and id, with their claims in order. Words and phrases of the query must stand in the fields or the claims."""
    within(limit=limit)
    found = scope(where)
    ok = claims if found is None else claims.where(F.col("source").isin(*found))
    terms = F.coalesce("key_terms", F.array()) if "key_terms" in claims.columns else F.array().cast("array<string>")
    each = rows.select(id_col, F.posexplode("claim_ids").alias("at", "claim_id")).join(ok.select("claim_id", "statement", "quote", terms.alias("key_terms")), "claim_id")
    gathered = each.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", "claim_id", "statement", "quote", "key_terms"))).alias("claims"))
    rows = rows.join(gathered, id_col).where((F.size("claim_ids") > 0) & (F.size("claims") == F.size("claim_ids")))
    if claim is not None:
        rows = rows.where(F.array_contains("claim_ids", claim))
    score = F.lit(0).cast("long")
    if query is not None:
        plan: SearchPlan = parse(query)
        said = F.array_join(F.transform("claims", lambda c: F.concat_ws(" ", c["statement"], c["quote"], F.array_join(c["key_terms"], " "))), " ")
        counts = [T.occurrences(F.col("words"), [w]) for w in plan.words]
        phrases = [T.occurrences(F.col("words"), list(p)) for p in plan.phrases]
        rows = rows.withColumn("words", T.spaced(T.normalize(F.concat_ws(" ", *fields, said))))
        for c in (*counts, *phrases):
            rows = rows.where(c > 0)
        score = (sum(phrases, F.lit(0)) * 100_000 + sum(counts, F.lit(0))).cast("long")
    told = F.transform("claims", lambda c: F.struct(c["claim_id"].alias("claim_id"), c["statement"].alias("statement"), c["quote"].alias("quote")))
    return rows.withColumn("score", score).select(id_col, *fields, told.alias("claims"), "score").orderBy(F.desc("score"), id_col).limit(limit)


def connections_of(connections: DataFrame, claims: DataFrame, query: str | None = None, where: Scope = "all", claim: str | None = None, limit: int = 10) -> DataFrame:
    """The connections that a query or a claim leads to."""
    return related(connections, "connection_id", ["type", "confidence", "summary", "explanation"], claims, query, where, claim, limit)


def themes_of(themes: DataFrame, claims: DataFrame, query: str | None = None, where: Scope = "all", claim: str | None = None, limit: int = 10) -> DataFrame:
    """The themes that a query or a claim leads to."""
    return related(themes, "theme_id", ["label", "summary"], claims, query, where, claim, limit)


# How much of a graph's answer is handed on.
MOST_RESULTS, MOST_RESULT_CLAIMS, TEXT_CLIP = 8, 5, 1200


def compact(connections: DataFrame, themes: DataFrame) -> DataFrame:
    """Connections, then themes, as rows of one shape (``graph_id``, ``kind``, ``type``, ``confidence``, ``summary``, ``explanation``,
    ``claims``): few rows, few claims each, clipped texts. Rows without id, or without summary and claims, go."""
    clip = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(TEXT_CLIP))
    claims = F.slice(F.transform("claims", lambda c: F.struct(c["claim_id"].alias("claim_id"), clip(c["statement"]).alias("statement"), clip(c["quote"]).alias("quote"))), 1, MOST_RESULT_CLAIMS).alias("claims")
    empty = F.lit("")

    def shape(rows: DataFrame, kind: str, id_col: str, summary: Column, *rest: Column) -> DataFrame:
        names = ("type", "confidence", "explanation")
        return rows.select(F.lit(kind).alias("kind"), F.col(id_col).alias("graph_id"), "score", clip(summary).alias("summary"), *(clip(c).alias(n) for n, c in zip(names, rest, strict=True)), claims)

    both = shape(connections, "connection", "connection_id", F.col("summary"), F.col("type"), F.col("confidence"), F.col("explanation")).unionByName(
        shape(themes, "theme", "theme_id", F.coalesce(F.nullif("summary", empty), F.col("label")), empty, empty, empty)
    )
    told = (F.coalesce("graph_id", empty) != "") & ((F.col("summary") != "") | (F.size("claims") > 0))
    return both.where(told).orderBy("kind", F.desc("score"), "graph_id").limit(MOST_RESULTS).select("graph_id", "kind", "type", "confidence", "summary", "explanation", "claims")


def cited(claims: DataFrame) -> DataFrame:
    """Claims with ``source``, ``path`` and ``anchor`` of their citation; the source may stand in the document's id instead."""
    where, anchor = F.substring_index("citation", "#", 1), F.when(F.contains("citation", F.lit("#")), F.substring_index("citation", "#", -1)).otherwise("")
    named = F.contains(where, F.lit(":"))
    source = F.when(named, F.substring_index(where, ":", 1)).when(F.contains("document_id", F.lit(":")), F.substring_index("document_id", ":", 1)).otherwise("")
    return claims.withColumns({"source": source, "path": F.when(named, F.substring_index(where, ":", -1)).otherwise(where), "anchor": anchor})


def graph_stats(claims: DataFrame, connections: DataFrame, themes: DataFrame, passages: DataFrame) -> DataFrame:
    """One row: claims, claims whose passage is known, connections, themes, claims that either names, unknown claims that they name."""
    linked = link_sources(claims, passages).agg(F.count(F.lit(1)).alias("claims"), F.count("passage").alias("with_passage"))
    edges = [rows.select(F.explode("claim_ids").alias("claim_id")) for rows in (connections, themes)]
    named = edges[0].unionAll(edges[1]).distinct().join(claims.select("claim_id", F.lit(1).alias("known")), "claim_id", "left")
    named = named.agg(F.count(F.lit(1)).alias("claims_in_graph"), F.count_if(F.col("known").isNull()).alias("unknown_claims"))
    rows = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return linked.crossJoin(rows(connections, "connections")).crossJoin(rows(themes, "themes")).crossJoin(named)  # one row each


def quotes_in(documents: DataFrame, quotes: DataFrame, gram: int = 24) -> DataFrame:
    """Which documents hold which quotes (in the form of ``evidence``), without comparing all pairs.

    Each quote is known by its rarest-looking fixed-length piece: documents and quotes meet in an equi-join on the
    quote's first ``gram`` characters, taken at every word start of a document, and containment is checked after.
    Shorter quotes meet on themselves cut to that length.
    """
    q = quotes.select("item_id", evidence(F.col("text")).alias("quote")).where("quote <> ''").withColumn("n", F.least(F.length("quote"), F.lit(gram)))
    sizes = sorted(r["n"] for r in q.select("n").distinct().collect())  # at most ``gram`` numbers
    d = documents.select("doc_id", evidence(F.coalesce("text", F.lit(""))).alias("body"))
    starts = [F.regexp_extract_all("body", F.lit(r"(?s)(?<![^ ])(?=(.{%d}))" % n), F.lit(1)) for n in sizes]
    pieces = F.array_distinct(F.flatten(F.array(*starts))) if sizes else F.array().cast("array<string>")
    met = d.select("doc_id", F.explode(pieces).alias("piece")).join(q.select("item_id", "quote", F.left("quote", F.col("n")).alias("piece")), "piece").select("doc_id", "item_id", "quote").distinct()
    met = staged(met, "met")  # its documents are few: only their texts are brought into the form again
    held = documents.select("doc_id", "text").join(met.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", evidence(F.coalesce("text", F.lit(""))).alias("body"))
    return met.join(held, "doc_id").where(F.contains(F.concat(F.lit(" "), "body"), F.concat(F.lit(" "), "quote"))).select("doc_id", "item_id").distinct()
