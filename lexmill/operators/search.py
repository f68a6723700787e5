"""Ranked lexical search over passages: terms, phrases, filters, fan-out, spelling help, citation lookup."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from difflib import SequenceMatcher
from itertools import islice, product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.query import QueryError, Scope, SearchPlan, distinct_queries, parse, scope, within
from ..sources.shared import staged
from .alike import alike
from .numbering import ordinals  # noqa: F401  (also asked for here)

FIELDS = ("title", "book", "text")
WEIGHTS = {"title": 1000, "book": 500, "text": 100}
PHRASE_WEIGHT = 100_000
RRF_SCALE, RRF_RANK = 100_000, 60
HIT_WEIGHT = 1_000_000
MOST_VARIANTS, LEAST_FUZZY = 8, 3
#: Shared anchors up to which they are sent to all tasks.
FEW_ANCHORS = 100_000


def passages_of(docs: DataFrame) -> DataFrame:
    """The documents table as passages of one document each."""
    return docs.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("source"), F.concat(F.lit("doc "), "doc_id").alias("title"), F.col("source").alias("book"),
        F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("relative_path"),
        F.lit("section-1/chunk-1").alias("anchor"), F.lit(0).alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"),
    )


def with_words(passages: DataFrame) -> DataFrame:
    """Adds the spaced words of each field; worth storing when many queries follow.

    They come out of a generator of one row, so that filters on them are not pushed into it: each text is
    normalised once, however many terms are looked for.
    """
    missing = [f for f in FIELDS if f"{f}_words" not in passages.columns]
    if not missing:
        return passages
    return passages.select("*", F.inline(F.array(F.struct(*(T.spaced(T.normalize(F.coalesce(F.col(f), F.lit("")))).alias(f"{f}_words") for f in missing)))))


def citation() -> Column:
    return F.concat("relative_path", F.when(F.col("anchor") != "", F.concat(F.lit("#"), "anchor")).otherwise(F.lit("")))


def in_scope(passages: DataFrame, where: Scope = "all", book: str | None = None, title: str | None = None) -> DataFrame:
    """Only passages of the scope's categories whose book and title hold the given texts."""
    found = scope(where)
    if found is not None:
        passages = passages.where(F.col("source").isin(*found))
    for field, part in (("book", book), ("title", title)):
        if part:
            passages = passages.where(F.contains(T.normalize(F.col(field)), F.lit(T.plain(part))))
    return passages


def matches(plan: SearchPlan) -> Column:
    """Every term somewhere, every phrase within one field."""
    found = F.lit(True)
    for run in [(w,) for w in plan.words] + list(plan.phrases):
        anywhere = F.lit(False)
        for f in FIELDS:
            anywhere = anywhere | F.contains(F.col(f"{f}_words"), F.lit(" " + " ".join(run) + " "))
        found = found & anywhere
    return found


def total(columns: Iterable[Column]) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + c
    return out


def term_matches(plan: SearchPlan, field: str) -> Column:
    return total(T.occurrences(F.col(f"{field}_words"), [w]) for w in plan.words)


def score(plan: SearchPlan) -> Column:
    """Phrases outweigh title, book and text terms in this order."""
    phrases = total(T.occurrences(F.col(f"{f}_words"), list(p)) for p in plan.phrases for f in FIELDS)
    fields = total(term_matches(plan, f) * (WEIGHTS[f] + 1) for f in FIELDS)
    return (phrases * PHRASE_WEIGHT + fields).cast("long")


def ordering(first: Column) -> list[Column]:
    return [first, F.lower("relative_path"), T.natural_key(F.col("anchor")), F.col("id")]


def snippets(context: int, plan: SearchPlan) -> Column:
    """The neighbourhood of the first match and the matched text, as written; for the few rows of a result."""
    wanted = [list(w) for w in {(w,) for w in plan.words} | set(plan.phrases)]

    def spans(text: str) -> tuple[list[tuple[str, int, int]], list[int]]:
        normal, back = [], []
        for at, c in enumerate(text):
            image = "".join(x.casefold() for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
            normal.append(image)
            back.extend([at] * len(image))
        joined, found, start = "".join(normal), [], None
        for i, c in enumerate(joined + " "):
            if c.isalnum():
                start = i if start is None else start
            elif start is not None:
                found.append((joined[start:i], start, i))
                start = None
        return found, back

    @F.pandas_udf("struct<snippet: string, matched_text: string, matched_in: string>")
    def make(title: pd.Series, book: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = []
        for values in zip(text, title, book, strict=True):
            for field, value in zip(("text", "title", "book"), values, strict=True):
                words, back = spans(value or "")
                hits = [(words[i][1], words[i + len(run) - 1][2]) for run in wanted for i in range(len(words) - len(run) + 1) if [w[0] for w in words[i : i + len(run)]] == run]
                if hits:
                    low, high = min(hits)
                    low, high = back[low], back[high - 1] + 1
                    a, b = max(0, low - context), min(len(value), high + context)
                    rows.append((("... " if a else "") + value[a:b].strip() + (" ..." if b < len(value) else ""), value[low:high], field))
                    break
            else:
                rows.append(("", "", "text"))
        return pd.DataFrame(rows, columns=["snippet", "matched_text", "matched_in"])

    return make("title", "book", "text")


def search(passages: DataFrame, query: str, where: Scope = "default", limit: int = 10, context: int | None = 220, book: str | None = None, title: str | None = None, distinct: bool = False) -> DataFrame:
    """The best passages with rank, score and citation; snippets are cut for them alone (none if ``context`` is none).

    ``distinct`` keeps the first id of equal normal texts under one anchor; a stored corpus has none, so it needs it not.
    """
    within(limit=limit, context=context or 0)
    plan = parse(query)
    found = with_words(in_scope(passages, where, book, title)).where(matches(plan))
    if distinct:
        found = first_wins(found, ["source", "relative_path", "anchor", "text_words"], [F.col("id")])
    scored = found.withColumn("score", score(plan)).withColumn("match_count", total(term_matches(plan, f) for f in FIELDS).cast("long"))
    top = scored.orderBy(*ordering(F.desc("score"))).limit(limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*ordering(F.desc("score")))))
    columns = ["rank", "id", "score", "source", "title", F.nullif("book", F.lit("")).alias("book"), "relative_path", "anchor", citation().alias("citation"), "match_count", F.lit(bool(plan.phrases)).alias("phrase_match")]
    if context is None:
        return ranked.select(*columns)
    return ranked.withColumn("cut", snippets(context, plan)).select(*columns, "cut.*")


def fan_out(
    passages: DataFrame, queries: list[str], where: Scope = "default", limit: int = 10, per_query_limit: int = 10, max_per_document: int = 1, book: str | None = None, title: str | None = None
) -> DataFrame:
    """Merges the best passages of several queries: hits count most, then reciprocal ranks, then the best score.

    All queries are scored in one scan; each keeps its best passages, which are merged by passage. A document
    gives ``max_per_document`` passages at most (0: any number).
    """
    within(limit=limit, per_query_limit=per_query_limit, max_per_document=max_per_document)
    asked = distinct_queries(queries)
    plans = [parse(q) for q in asked]
    words = with_words(in_scope(passages, where, book, title))
    runs = F.array(*(F.struct(F.lit(i).alias("q"), F.lit(q).alias("query"), F.when(matches(p), score(p)).alias("score")) for i, (q, p) in enumerate(zip(asked, plans, strict=True))))
    keep = ["id", "source", "title", "book", "relative_path", "anchor"]
    each = words.select(*keep, F.explode(runs).alias("run")).where(F.col("run.score").isNotNull())
    rank = F.row_number().over(Window.partitionBy("run.q").orderBy(*ordering(F.desc("run.score"))))
    best = each.withColumn("rank", rank).where(F.col("rank") <= per_query_limit)
    run = F.struct("run.q", "run.query", "rank", "run.score")
    merged = best.groupBy("id").agg(*(F.first(c).alias(c) for c in keep[1:]), F.array_sort(F.collect_list(run)).alias("evidence"))
    rrf = F.aggregate("evidence", F.lit(0.0), lambda acc, x: acc + F.lit(float(RRF_SCALE)) / (F.lit(RRF_RANK) + x["rank"]))
    top = F.array_max(F.transform("evidence", lambda x: F.struct(x["score"].alias("score"), (-x["rank"]).alias("rank"))))
    ranked = (
        merged.withColumn("query_hits", F.size("evidence"))
        .withColumn("best_score", top["score"])
        .withColumn("best_rank", -top["rank"])
        .withColumn("aggregate_score", F.col("query_hits").cast("long") * HIT_WEIGHT + F.bround(rrf, 0).cast("long") + F.col("best_score"))
        .withColumn("document_key", F.concat("source", F.lit(":"), "relative_path"))
    )
    order = [F.desc("aggregate_score"), F.desc("query_hits"), *ordering(F.desc("best_rank"))]
    if max_per_document:
        ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy("document_key").orderBy(*order))).where(F.col("k") <= max_per_document)
    top_rows = ranked.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return top_rows.select(
        "rank", *keep, citation().alias("citation"), "query_hits", F.transform("evidence", lambda x: x["query"]).alias("matched_queries"),
        F.transform("evidence", lambda x: F.struct(x["query"].alias("query"), x["rank"].alias("rank"), x["score"].alias("score"))).alias("query_evidence"),
        "best_rank", "best_score", "aggregate_score", "document_key",
    )


def vocabulary(passages: DataFrame) -> DataFrame:
    """How many passages of a source have a term, and how often; one shuffle, summed before it."""
    words = T.tokens(T.normalize(F.concat_ws(" ", "title", "book", "text")))
    both = F.concat(F.transform("words", lambda w: F.struct(w.alias("term"), F.lit(0).alias("d"))), F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("term"), F.lit(1).alias("d"))))
    each = passages.select("source", words.alias("words")).select("source", F.explode(both).alias("w"))
    return each.groupBy("source", F.col("w.term").alias("term")).agg(
        F.sum("w.d").cast("long").alias("document_frequency"), F.sum(1 - F.col("w.d")).cast("long").alias("term_frequency")
    )


def document_frequencies(passages: DataFrame) -> DataFrame:
    """How many passages have a term, whatever their source; no row for a term's further places."""
    words = T.tokens(T.normalize(F.concat_ws(" ", "title", "book", "text")))
    each = passages.select(F.explode(F.array_distinct(words)).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("document_frequency"))


def roll_up(terms: DataFrame, where: Scope = "all") -> DataFrame:
    """A vocabulary over the sources of a scope."""
    found = scope(where)
    rows = terms if found is None else terms.where(F.col("source").isin(*found))
    return rows.groupBy("term").agg(F.sum("document_frequency").alias("document_frequency"), F.sum("term_frequency").alias("term_frequency"))


def likeness(one: str, other: str) -> Column:
    """Share of matching runs of two columns' strings, to four places."""

    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(SequenceMatcher(None, x, y).ratio(), 4) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(ratio, "double")(one, other)


def all_near_terms(terms: DataFrame, words: list[str], max_distance: int | None = None) -> DataFrame:
    """Every vocabulary term within the allowed distance of a word that the vocabulary lacks.

    Words shorter than three characters get none. The words of a query are a handful, so they are broadcast.
    """
    asked = sorted({w for w in map(T.plain, words) if len(w) >= LEAST_FUZZY})
    spark = terms.sparkSession
    values = spark.range(1).select(F.explode(F.array(*map(F.lit, asked))).alias("word")) if asked else spark.range(0).select(F.lit("").alias("word"))
    known = terms.where(F.col("term").isin(*asked)).select(F.col("term").alias("word"))
    unknown = values.join(known, "word", "left_anti").withColumn("most", F.lit(max_distance) if max_distance is not None else T.allowed_distance(F.col("word")))
    near = terms.where(F.length("term") >= LEAST_FUZZY).join(F.broadcast(unknown), F.abs(F.length("term") - F.length("word")) <= F.col("most"))
    return near.withColumn("distance", F.levenshtein("word", "term")).where(F.col("distance") <= F.col("most")).drop("most")


def near_terms(terms: DataFrame, words: list[str], per_token_limit: int = 3, max_distance: int | None = None) -> DataFrame:
    """The nearest terms to each unknown word: distance, likeness, frequencies, ``k``."""
    within(per_token_limit=per_token_limit, **({"max_distance": max_distance} if max_distance is not None else {}))
    near = all_near_terms(terms, words, max_distance).withColumn("similarity", likeness("word", "term"))
    order = [F.col("distance"), F.desc("similarity"), F.desc("document_frequency"), F.desc("term_frequency"), F.col("term")]
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("word").orderBy(*order))).where(F.col("k") <= per_token_limit)
    return ranked.select("word", "k", "term", "distance", "similarity", "document_frequency", "term_frequency")


def corrections(terms: DataFrame, query: str, per_token_limit: int = 3, max_distance: int | None = None) -> list[str]:
    """The query, then its corrected spellings: each word's suggestions in turn, the last word's fastest, at most eight."""
    words = T.python_words(query)
    found: dict[str, list[str]] = {}
    for row in near_terms(terms, words, per_token_limit, max_distance).orderBy("word", "k").collect():  # at most ten a word
        found.setdefault(row["word"], []).append(row["term"])
    if not found:
        return [query]
    return [query, *islice((" ".join(p) for p in product(*(found.get(w, [w]) for w in words))), MOST_VARIANTS)]


def fuzzy(passages: DataFrame, query: str, where: Scope = "default", per_token_limit: int = 3, max_distance: int | None = None, **options: int) -> DataFrame:
    """Fan-out over the query and its corrected spellings; the vocabulary is that of the scope."""
    terms = roll_up(vocabulary(in_scope(passages, where)))
    return fan_out(passages, corrections(terms, query, per_token_limit, max_distance), where, **options)


def around(passages: DataFrame, cited: str, context_passages: int = 4) -> DataFrame:
    """The passage of a citation (``source:path#anchor`` or ``path#anchor``) and its neighbours by ordinal."""
    within(context_passages=context_passages)
    path, _, anchor = cited.partition("#")
    if not anchor:
        raise QueryError("a citation needs an anchor")
    source, found, rest = path.partition(":")
    rows = passages.where(F.col("relative_path") == (rest if found else path))
    if found:
        rows = rows.where(F.col("source") == source)
    hit = rows.where(F.col("anchor") == anchor).orderBy("source", "ordinal", "id").limit(1).select("source", "relative_path", F.col("ordinal").alias("centre"))
    near = rows.join(F.broadcast(hit), ["source", "relative_path"]).where(F.col("ordinal").between(F.greatest(F.col("centre") - context_passages, F.lit(0)), F.col("centre") + context_passages))
    return near.withColumn("selected", (F.col("ordinal") == F.col("centre")) & (F.col("anchor") == anchor)).drop("centre").orderBy("ordinal", "id")


def neighbours(passages: DataFrame, reach: int) -> DataFrame:
    """Every passage with the ids of those within ``reach`` ordinals of it in its file.

    Ids travel to the ordinals they are near to, so a file of any length is spread over tasks.
    """
    keys = ["source", "relative_path", "ordinal"]
    reached = passages.select("source", "relative_path", F.explode(F.sequence(F.col("ordinal") - reach, F.col("ordinal") + reach)).alias("ordinal"), "id")
    return alike(passages, reached.groupBy(*keys).agg(F.array_sort(F.collect_list("id")).alias("near")), keys)


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in order."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def first_of_equal(passages: DataFrame) -> DataFrame:
    """Of passages with equal normal texts under one anchor the first by ordinal, told by their digests.

    Only passages that share source, path and anchor can be equal, so that only these are brought together; as a rule an anchor has one passage.
    """
    keys = ["source", "relative_path", "anchor"]
    several = staged(passages.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*(F.col(k).alias(f"__{k}") for k in keys)), "anchors")
    many = several.count()
    if not many:
        return passages
    named = F.broadcast(several) if many <= FEW_ANCHORS else several
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    digests = passages.join(named, same, "left_semi").withColumn("__normal", F.sha2(T.normalize(F.col("text")), 256))
    return passages.join(named, same, "left_anti").unionByName(first_wins(digests, [*keys, "__normal"], [F.col("ordinal")]).drop("__normal"))


def last_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row of each key: the last in position."""
    return first_wins(rows, keys, [F.desc(position)])


def stats(passages: DataFrame) -> DataFrame:
    """Passages, documents and characters of each source; the row without source is the total."""
    return passages.groupBy("source").agg(F.count(F.lit(1)).alias("passages"), F.countDistinct("relative_path").alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))
