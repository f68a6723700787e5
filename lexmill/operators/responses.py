"""What a model answered: parsed or told why not, its claims judged item by item, and what of an earlier run still holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import staged
from .graph import ATTRIBUTIONS, CLAIM_TYPES, MODALITIES, MOST_PER_DOCUMENT, claim_id, evidence
from .numbering import positions

# Why a claim may have been chosen, and how long texts may be.
SELECTION_BASES = (
    "distinctive_definition", "non_obvious_proposition", "causal_explanation", "practical_prescription", "meaningful_distinction", "classification_or_framework", "unusual_factual_claim",
    "unique_concept", "important_qualification",
)
STATEMENT_CLIP, QUALIFIERS_CLIP, TERM_CLIP, MOST_TERMS = 3000, 1600, 120, 8


def unfenced(text: Column) -> Column:
    """A response without the code fence around it, of which either end may be missing."""
    edge = f"^{T.BLANK}+|{T.BLANK}+$"
    bare = F.regexp_replace(text, edge, "")
    bare = F.when(bare.startswith("```json"), F.substr(bare, F.lit(8))).when(bare.startswith("```"), F.substr(bare, F.lit(4))).otherwise(bare)
    return F.regexp_replace(F.when(bare.endswith("```"), F.left(bare, F.length(bare) - 3)).otherwise(bare), edge, "")


def kind(value: Column) -> Column:
    """The outer kind of a JSON value: STRING, OBJECT, ARRAY, BIGINT ..., VOID for null; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def field(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "variant")


def string(item: Column, name: str) -> Column:
    """A field's text; null if it is no string."""
    return F.when(kind(field(item, name)) == "STRING", F.try_variant_get(item, f"$.{name}", "string"))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns that come out of a generator of one row, so that what reads them doesn't compute them again."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def parsed(responses: DataFrame, array: str = "items") -> DataFrame:
    """Responses (``response`` and any other columns) with ``payload`` and ``error``: nothing is thrown, a row has one or the other.

    Errors: ``invalid JSON`` (also null and empty ones, and objects that repeat a key), ``not an object``, ``no array``.
    """
    rows = once(once(responses, bare=unfenced(F.col("response"))), payload=F.try_parse_json("bare")).drop("bare")
    error = F.when(F.col("payload").isNull(), "invalid JSON").when(kind(F.col("payload")) != "OBJECT", "not an object").when(F.coalesce(kind(field(F.col("payload"), array)), F.lit("")) != "ARRAY", "no array")
    return once(rows, error=error).withColumn("payload", F.when(F.col("error").isNull(), F.col("payload")))


def good_and_skipped(rows: DataFrame, key: str, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and ``key`` and error of the others: what could not be read is listed, once, and stops nothing."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull()).select(key, F.col(error).alias("reason")).distinct()


def items(good: DataFrame, order: str, array: str = "items") -> DataFrame:
    """One row per element of the payloads' arrays: ``position`` from 1 over all responses in ``order``, and the ``item``."""
    each = good.select(order, F.posexplode(F.try_variant_get("payload", f"$.{array}", "array<variant>")).alias("at", "value"))
    # a variant can't be dealt by ranges; its text is
    told = positions(each.select(order, "at", F.to_json("value").alias("value")), [order, "at"], "place")
    return told.select((F.col("place") + 1).alias("position"), F.parse_json("value").alias("item"))


def flaw(item: Column, known_document: Column, known_passage: Column) -> Column:
    """The first thing that is wrong with an item by itself, in the order in which it is looked at, after its document."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    among = lambda name, values: F.coalesce(string(item, name).isin(*values), F.lit(False))
    terms = F.try_variant_get(item, "$.key_terms", "array<variant>")
    proper = F.forall(terms, lambda t: (kind(t) == "STRING") & (F.trim(F.try_variant_get(t, "$", "string")) != ""))
    return (
        F.when(~among("type", CLAIM_TYPES), "unsupported claim type")
        .when(blank(string(item, "statement")), "no statement")
        .when(blank(string(item, "quote")), "no evidence quote")
        .when(known_document & ~known_passage, "unknown passage")
        .when(~among("modality", MODALITIES), "unsupported modality")
        .when(~among("attribution", ATTRIBUTIONS), "unsupported attribution")
        .when(string(item, "qualifiers").isNull(), "invalid qualifiers")
        .when((F.coalesce(kind(field(item, "key_terms")), F.lit("")) != "ARRAY") | ~F.coalesce(proper, F.lit(False)), "invalid key terms")
        .when(~among("selection_basis", SELECTION_BASES), "unsupported selection basis")
    )


def judge(found: DataFrame, passages: DataFrame, per_document: int = MOST_PER_DOCUMENT, total: int | None = None) -> DataFrame:
    """Each item (``position``, ``item``) with the first ``reason`` against it, or none and a ``claim_id``.

    ``passages``: document_id, passage_id, anchor, text. Limits hold from the position of the last claim that fits, so whatever a
    document says after it is not looked at; these positions are found with a row number that is cut in each task, and no document's
    items are gathered.
    """
    item = F.col("item")
    rows = found.select("position", "item", F.when(kind(item) == "OBJECT", string(item, "document_id")).alias("document_id"), F.when(kind(item) == "OBJECT", string(item, "passage_id")).alias("passage_id"))
    documents = passages.select("document_id", F.lit(True).alias("known_document")).distinct()
    places = passages.select("document_id", "passage_id", "anchor", evidence(F.col("text")).alias("held")).dropDuplicates(["document_id", "passage_id"])
    rows = rows.join(documents, "document_id", "left").join(places, ["document_id", "passage_id"], "left")
    quote = evidence(F.coalesce(string(item, "quote"), F.lit("")))
    early = F.when(kind(item) != "OBJECT", "not an object").when(F.col("known_document").isNull(), "unknown document")
    rows = rows.withColumn("evidence", quote).withColumn("early", early)
    rows = once(rows, own=F.coalesce(flaw(item, F.lit(True), F.col("held").isNotNull()), F.when(~F.contains("held", "evidence"), "quote not found"))).drop("held", "known_document")
    fit = F.col("early").isNull() & F.col("own").isNull()
    again = F.row_number().over(Window.partitionBy(fit, "document_id", "passage_id", "evidence").orderBy("position")) > 1
    rows = rows.withColumn("own", F.coalesce("own", F.when(fit & again, "repeated evidence")))
    # limits read the rows twice more: written once, the texts are compared once
    rows = staged(rows.withColumn("item", F.to_json("item")), "own").withColumn("item", F.parse_json("item"))
    sound = rows.where("early IS NULL AND own IS NULL").select("document_id", "position")
    nth = sound.withColumn("k", F.row_number().over(Window.partitionBy("document_id").orderBy("position"))).where(F.col("k") <= per_document)
    last = nth.groupBy("document_id").agg(F.max(F.when(F.col("k") == per_document, F.col("position"))).alias("last")).where("last IS NOT NULL")
    rows = rows.join(last, "document_id", "left")
    late = F.when(F.col("position") > F.col("last"), "document limit")
    reason = F.coalesce("early", late, "own")
    if total is not None:
        final = nth.orderBy("position").limit(total).agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("end")).first()  # one row
        if final["n"] == total:
            reason = F.coalesce(F.when(F.col("position") > final["end"], "total limit"), reason)
    rows = rows.withColumn("reason", reason)
    return rows.select("position", "item", "document_id", "passage_id", "anchor", "reason", F.when(F.col("reason").isNull(), claim_id(F.col("document_id"), F.col("passage_id"), string(item, "quote"))).alias("claim_id"))


def claims(judged: DataFrame) -> DataFrame:
    """The accepted items as claims, clipped."""
    item = F.col("item")
    cut = lambda name, most: F.left(F.trim(string(item, name)), F.lit(most)).alias(name)
    terms = F.transform(F.slice(F.try_variant_get(item, "$.key_terms", "array<string>"), 1, MOST_TERMS), lambda t: F.left(F.trim(t), F.lit(TERM_CLIP)))
    told = [string(item, name).alias(name) for name in ("type", "modality", "attribution", "selection_basis")]
    return judged.where("reason IS NULL").select("position", "claim_id", "document_id", "passage_id", "anchor", *told, cut("statement", STATEMENT_CLIP), cut("quote", STATEMENT_CLIP), cut("qualifiers", QUALIFIERS_CLIP), terms.alias("key_terms"))


# --- resuming --------------------------------------------------------------------------------


def content_key(*columns: str) -> Column:
    """A digest of what a document is: nulls and empty texts differ, and no column runs into the next."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def same_settings(stored: Column, current: Column, tolerated: dict[str, tuple[str, ...]]) -> Column:
    """Whether two maps of settings agree: in every name, but for those whose stored value is among the ``tolerated`` older ones."""
    differs = lambda name: ~stored[name].eqNullSafe(current[name])
    names = F.array_union(F.map_keys(stored), F.map_keys(current))
    excused = F.lit(False)
    if tolerated:
        old = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in tolerated.items() for x in kv))
        excused = lambda name: F.coalesce(F.array_contains(old[name], stored[name]), F.lit(False))
        return ~F.exists(names, lambda name: differs(name) & ~excused(name))
    return ~F.exists(names, differs)


def resumed(documents: DataFrame, stored: DataFrame, tolerated: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``document_id`` and ``state`` of every document, present or stored: new, changed, other settings, unchanged, gone.

    ``documents`` and ``stored``: document_id, content (a ``content_key``), settings (a map). Only new and changed documents and those of other settings are to be
    done again; of repeated stored rows any that is unchanged counts.
    """
    old = stored.select("document_id", F.col("content").alias("was"), F.col("settings").alias("by"), F.lit(True).alias("kept"))
    met = documents.select("document_id", "content", "settings", F.lit(True).alias("here")).join(old, "document_id", "full")
    agrees = same_settings(F.col("by"), F.col("settings"), tolerated or {})
    rank = F.when(F.col("here").isNull(), 4).when(F.col("kept").isNull(), 3).when(~F.col("content").eqNullSafe(F.col("was")), 2).when(~F.coalesce(agrees, F.lit(False)), 1).otherwise(0)
    names = F.array(*map(F.lit, ("unchanged", "other settings", "changed", "new", "gone")))
    return met.groupBy("document_id").agg(F.min(rank).alias("rank")).select("document_id", F.get(names, F.col("rank")).alias("state"))


def still_known(aggregates: DataFrame, known: DataFrame, key: str = "position") -> DataFrame:
    """``key`` and ``valid`` of rows with ``claim_ids``: whether all of them are among the ``known`` claims. No ids are all known."""
    each = aggregates.select(key, F.explode("claim_ids").alias("claim_id")).join(known.select("claim_id", F.lit(True).alias("in")).distinct(), "claim_id", "left")
    missing = each.where(F.col("in").isNull()).select(key).distinct()
    return aggregates.select(key).distinct().join(missing.withColumn("missing", F.lit(True)), key, "left").select(key, F.col("missing").isNull().alias("valid"))
