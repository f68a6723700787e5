"""Glossary: mining terms that an English baseline lacks, ranking them, and looking them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import python_words

#: Points for each reason that speaks for a term.
WEIGHTS = {"definition_context": 6, "multiword_non_english": 5, "quoted": 4, "italic": 4, "not_in_english_baseline": 2}
#: A term starts with letters or digits, marks attached, and may go on after one apostrophe.
TERM = r"[\p{L}\p{N}][\p{L}\p{N}̀-ͯ]*(?:['’][\p{L}\p{N}̀-ͯ]+)?"
#: Irregular forms and their bases.
IRREGULAR = {
    "are": "be", "been": "be", "being": "be", "children": "child", "did": "do", "does": "do", "feet": "foot", "geese": "goose", "has": "have", "having": "have",
    "is": "be", "men": "man", "mice": "mouse", "people": "person", "teeth": "tooth", "was": "be", "women": "woman", "were": "be",
}
#: Suffix, what replaces it, and the least length of a word it is taken from.
SUFFIXES = (("ies", "y", 5), ("ied", "y", 5), ("es", "", 5), ("s", "", 4), ("ed", "", 5), ("ed", "e", 5), ("ing", "", 6), ("ing", "e", 6), ("er", "", 5), ("er", "e", 5), ("est", "", 6), ("est", "e", 6))
#: Fixed value: what announces a definition.
DEFINES = r"\b(?:means?|refers?\s+to|is\s+(?:called|known\s+as|defined\s+as)|are\s+(?:called|known\s+as)|also\s+known\s+as|denotes?|meaning)\b"
#: Fixed value: suffixes of derived words, what replaces them, and the least length of a word; tried in plain ASCII words of seven letters or more.
DERIVED = (
    ("ly", "", 7), ("entially", "ence", 9), ("ically", "ic", 7), ("ed", "", 7), ("ed", "e", 7), ("ed", "ing", 7), ("ing", "", 8), ("ing", "e", 8),
    ("ation", "ate", 9), ("ation", "ating", 9), ("tion", "te", 8), ("tion", "ting", 8),
)


def lookup_forms(word: Column) -> Column:
    """The word and the base forms it may come from."""
    forms = [word, F.create_map(*(F.lit(x) for kv in IRREGULAR.items() for x in kv))[word]]
    forms += [F.when(word.endswith(s) & (F.length(word) >= n), F.concat(F.left(word, F.length(word) - len(s)), F.lit(put))) for s, put, n in SUFFIXES]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def derived_forms(word: Column) -> Column:
    """Forms that an English word may be derived from; none for short words and those of other letters."""
    forms = [F.when(word.endswith(s) & (F.length(word) >= n), F.concat(F.left(word, F.length(word) - len(s)), F.lit(put))) for s, put, n in DERIVED]
    return F.when(word.rlike("^[a-z]{7,}$"), F.array_except(F.array_distinct(F.array_compact(F.array(*forms))), F.array(word))).otherwise(F.array().cast("array<string>"))


def has_marks(text: Column) -> Column:
    """Whether a text has letters with marks, composed or not."""
    return F.lower(text) != T.normalize(text)


def candidate_key(term: Column) -> Column:
    """The key of a term in an audit."""
    return F.concat(F.lit("g_"), F.left(F.sha2(term, 256), F.lit(20)))


def rest_of_surface(surface: Column) -> Column:
    """A surface without white space runs and without marks of punctuation around it."""
    return F.regexp_replace(T.collapse(surface), r"^[ .,;:!?()\[\]{}\"“”‘’]+|[ .,;:!?()\[\]{}\"“”‘’]+$", "")


def excerpt(text: Column, most: int = 480) -> Column:
    """A text on one line, cut to ``most`` characters with three dots."""
    flat = T.collapse(text)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(F.left(flat, F.lit(most - 3)), " +$", ""), F.lit("...")))


def surface_frequency(docs: DataFrame) -> DataFrame:
    """``term`` and a map from its surfaces, in order, to how often each occurs."""
    counted = positions(docs).groupBy("surface").agg(F.count(F.lit(1)).alias("n")).withColumn("term", T.normalize(F.col("surface")))
    return counted.groupBy("term").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("surface", "n")))).alias("surface_frequency"))


def positions(docs: DataFrame) -> DataFrame:
    """``doc_id``, position and surface of every term token."""
    surfaces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TERM), F.lit(0))
    return docs.select("doc_id", F.posexplode(surfaces).alias("at", "surface"))


def candidates(docs: DataFrame, baseline: DataFrame, least: int = 3) -> DataFrame:
    """Terms whose base forms the baseline (``word``) lacks: frequency, documents, surfaces and priority.

    Terms are counted before they meet the baseline, so that it meets each distinct term once; spellings are gathered of distinct surfaces, not of every document's.
    """
    surfaces = positions(docs).select("doc_id", "surface").where(F.col("surface").rlike(r"\p{L}"))
    term = T.normalize(F.col("surface"))
    counted = surfaces.select("doc_id", term.alias("term")).where(F.length("term") >= least).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    terms = counted.groupBy("term").agg(F.sum("n").alias("frequency"), F.count("doc_id").alias("documents"))
    each = surfaces.select("surface").distinct().select(term.alias("term"), "surface")
    spelt = each.groupBy("term").agg(F.array_sort(F.collect_list("surface")).alias("surfaces"))
    known = baseline.select(F.col("word").alias("form")).distinct()
    english = each.select("term").distinct().select("term", F.explode(lookup_forms(F.col("term"))).alias("form")).join(known, "form", "left_semi").select("term").distinct()
    told = terms.join(english, "term", "left_anti").join(spelt, "term").select("term", "frequency", "documents", "surfaces")
    return told.withColumn("priority", priority(F.array(F.lit("not_in_english_baseline")), F.col("documents"), F.lit(1)))


def priority(reasons: Column, documents: Column, tokens: Column) -> Column:
    """Points of the reasons, and a little for documents and tokens."""
    points = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    return (F.aggregate(reasons, F.lit(0), lambda acc, r: acc + points[r]) + F.least(documents, F.lit(5)) + F.least(tokens, F.lit(4))).cast("long")


def runs(docs: DataFrame, baseline: DataFrame, least: int = 3) -> DataFrame:
    """Runs of two or more adjacent unknown terms of a line, as gaps and islands over positions."""
    surfaces = F.regexp_extract_all(F.col("line"), F.lit(TERM), F.lit(0))
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}̀-ͯ'’ /-]+")).alias("part", "line"))
    each = lines.select("doc_id", "part", F.posexplode(surfaces).alias("at", "surface")).withColumn("term", T.normalize(F.col("surface")))
    known = baseline.select(F.col("word").alias("form")).distinct()
    distinct = lines.select(F.explode(F.array_distinct(surfaces)).alias("surface")).distinct().select(T.normalize(F.col("surface")).alias("term")).distinct()
    english = distinct.select("term", F.explode(lookup_forms(F.col("term"))).alias("form")).join(known, "form", "left_semi").select("term").distinct()
    unknown = each.where((F.length("term") >= least) & F.col("surface").rlike(r"\p{L}")).join(F.broadcast(english), "term", "left_anti")
    w = Window.partitionBy("doc_id", "part").orderBy("at")
    island = unknown.withColumn("island", F.col("at") - F.row_number().over(w))
    found = island.groupBy("doc_id", "part", "island").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("terms")).where(F.size("terms") >= 2)
    return found.select("doc_id", "part", F.array_join(F.transform("terms", lambda x: x["term"]), " ").alias("run"), F.size("terms").alias("tokens"))


def quoted_terms(docs: DataFrame, most_words: int = 8) -> DataFrame:
    """Texts in double quotes (one to eight words), with whether a defining phrase follows within 72 characters."""
    pattern = r"[\"“]([^\"“”\n]{1,200})[\"”](?=([^\n]{0,72}))"
    text = F.coalesce("text", F.lit(""))
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("surface"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("after"))
    each = docs.select("doc_id", F.posexplode(zipped).alias("at", "q")).select("doc_id", "at", T.collapse(F.col("q.surface")).alias("surface"), F.col("q.after").rlike(r"(?i)" + DEFINES).alias("defined"))
    count = F.size(T.tokens(T.normalize(F.col("surface"))))
    return each.where((count >= 1) & (count <= most_words)).withColumn("term", T.normalize(F.col("surface")))


def lookup(entries: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """Entries with exactly this normal form, canonical form or variant, in this order of preference."""
    wanted = F.lit(" ".join(python_words(term)))
    key = lambda c: F.trim(T.spaced(T.normalize(c)))
    kind = (
        F.when(key(F.col("normalized_form")) == wanted, 0).when(key(F.col("canonical_surface_form")) == wanted, 1).when(F.exists("variants", lambda v: key(v) == wanted), 2)
    )
    return entries.withColumn("kind", kind).where("kind is not null").orderBy("kind", "normalized_form", "canonical_surface_form").limit(limit)


def search(entries: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Exact entries, then those that hold the words in order, then those that hold all of them; fewer other words first."""
    words = python_words(query)
    names = F.concat(F.array(F.struct(F.lit(0).alias("k"), F.col("normalized_form").alias("x")), F.struct(F.lit(1).alias("k"), F.col("canonical_surface_form").alias("x"))), F.transform("variants", lambda v: F.struct(F.lit(2).alias("k"), v.alias("x"))))

    def rank(name: Column) -> Column:
        spaced = T.spaced(T.normalize(name["x"]))
        extra = F.size(T.tokens(spaced)) - len(words)
        all_in = F.lit(True)
        for w in words:
            all_in = all_in & F.contains(spaced, F.lit(f" {w} "))
        joined = " ".join(words)
        return F.when(F.trim(spaced) == joined, F.struct(name["k"].alias("rank"), F.lit(0).alias("extra"))).when(F.contains(spaced, F.lit(f" {joined} ")), F.struct(F.lit(3).alias("rank"), extra.alias("extra"))).when(all_in, F.struct(F.lit(4).alias("rank"), extra.alias("extra")))

    best = F.array_min(F.filter(F.transform(names, rank), lambda x: x.isNotNull()))
    return entries.withColumn("best", best).where("best is not null").orderBy("best", "normalized_form", "canonical_surface_form").limit(limit)
