"""Registered queries of the glossary build, over all conversations, with their DuckDB twins.

The tables hold prose without quotation marks, emphasis or definitions. So the conversations' texts get them by rule, on both
sides alike: the two words after an article go into quotation marks, the word after an "and" is set in italics in the raw
markup, and a verb between blanks becomes a defining one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import glossary
from .operators import glossary_build as build
from .queries import query, sql_normal, sql_text, table
from .queries_more import BASES_SQL, sql_forms

ARTICLES, VERBS, ANDS = "la|le|der|die|the|of|el|los", "est|ist|is|es|was|se", "et|und|and|y"
QUOTE_RULE = (rf' ({ARTICLES}) ([^ "<\n]+ [^ "<\n]+) ', ' {0}1 "{0}2" ')
VERB_RULE = (f" (?:{VERBS}) ", " means ")
ITALIC_RULE = (rf' ({ANDS}) ([^ "<\n]+) ', " {0}1 <i>{0}2</i> ")
#: Zipf frequencies that suit tables of a few hundred thousand words; there are at most 10 ** 5.5 words above the floor.
FLOOR, LIMITS = 3.5, {"common": 5.5, "derived_from": 5.0, "derived_self": 4.0}


def marked_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as their passages."""
    replace = lambda c, rule: F.regexp_replace(c, rule[0], rule[1].format("$"))
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select(
        F.lpad(F.col("conv_id").cast("string"), 8, "0").alias("document"), F.col("turn").cast("int").alias("ordinal"), F.concat(F.lit("conversation "), F.col("conv_id")).alias("title"),
        F.concat(F.lit("turn-"), F.col("turn")).alias("anchor"), replace(replace(text, QUOTE_RULE), VERB_RULE).alias("text"), replace(text, ITALIC_RULE).alias("raw"),
    )


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon: the words of all benchmark items as a list, and those of all conversations ranked by frequency."""
    words = lambda t: F.explode(T.tokens(T.normalize(F.coalesce("text", F.lit("")))))
    counts = table(spark, sf_dir, "conversations").select(words("text").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return build.lexicon(table(spark, sf_dir, "benchmark").select(words("text").alias("word")).distinct(), build.zipf(counts, FLOOR))


def sql_replaced(text: str, *rules: tuple[str, str]) -> str:
    for pattern, image in rules:
        text = f"regexp_replace({text}, {sql_text(pattern)}, {sql_text(image.format(chr(92)))}, 'g')"
    return text


BODY = "coalesce(text, '')"
PASSAGES_SQL = f"""p AS MATERIALIZED (
  SELECT lpad(conv_id::VARCHAR, 8, '0') AS document, turn::INTEGER AS ordinal, 'conversation ' || conv_id AS title, 'turn-' || turn AS anchor,
         {sql_replaced(BODY, QUOTE_RULE, VERB_RULE)} AS text, {sql_replaced(BODY, ITALIC_RULE)} AS raw FROM conversations)"""


def sql_words(name: str, source: str, keys: str) -> str:
    """Tokens of ``source`` (``keys``, ``text``) with number, surface, place, and what stands before each."""
    return f"""{name} AS MATERIALIZED (
  SELECT *, e - length(surface) AS s, {sql_normal('surface')} AS term FROM (
    SELECT {keys}, i, surface, gap, sum(length(gap) + length(surface)) OVER (PARTITION BY {keys} ORDER BY i)::INTEGER AS e FROM (
      SELECT {keys}, unnest(range(1, len(words) + 1))::INTEGER AS i, unnest(words) AS surface, unnest(gaps[1:len(words)]) AS gap FROM (
        SELECT {keys}, regexp_extract_all(text, {sql_text(glossary.TERM)}) AS words, regexp_split_to_array(text, {sql_text(glossary.TERM)}) AS gaps FROM {source}))))"""


LEXICON_SQL = f"""counted AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all({sql_normal(BODY)}, '[\\p{{L}}\\p{{N}}]+')) AS word FROM conversations) GROUP BY word),
ranked AS (SELECT word, round(log10(n * 1e9 / (SELECT sum(n) FROM counted)), 2) AS zipf FROM counted),
lex AS MATERIALIZED (SELECT word, bool_or(listed) AS listed, max(zipf) AS zipf FROM (
  SELECT unnest(regexp_extract_all({sql_normal(BODY)}, '[\\p{{L}}\\p{{N}}]+')) AS word, true AS listed, NULL::DOUBLE AS zipf FROM benchmark
  UNION ALL SELECT word, false, zipf FROM ranked WHERE zipf >= {FLOOR}) GROUP BY word)"""
LAYERS_SQL = f"""told AS MATERIALIZED (SELECT DISTINCT surface, term FROM (SELECT surface, term FROM w UNION ALL SELECT surface, term FROM mw)),
own AS (SELECT surface, unnest(list_filter([term, b[term], {sql_forms(glossary.SUFFIXES, 'term')}], lambda x: x IS NOT NULL)) AS word FROM told, (SELECT {BASES_SQL} AS b)),
origin AS (SELECT surface, unnest(list_filter([{sql_forms(glossary.DERIVED, 'term')}], lambda x: x IS NOT NULL AND x <> term)) AS word FROM told
  WHERE regexp_full_match(surface, '[A-Za-z]+') AND regexp_full_match(term, '[a-z]{{7,}}')),
own_best AS (SELECT surface, bool_or(listed) AS listed, max(zipf) AS zipf FROM own JOIN lex USING (word) GROUP BY surface),
origin_best AS (SELECT surface, max(zipf) AS origin FROM origin JOIN lex USING (word) GROUP BY surface),
k AS MATERIALIZED (
  SELECT *, layer IS NULL AND length(term) >= 2 AND regexp_matches(surface, '\\p{{L}}') AS candidate, candidate OR lower(surface) <> term OR coalesce(zipf > 0 AND zipf < {LIMITS['common']}, false) AS special
  FROM (SELECT surface, term, zipf, CASE WHEN listed THEN 'list' WHEN zipf >= {LIMITS['common']} THEN 'frequency' WHEN zipf >= {LIMITS['derived_self']} AND origin >= {LIMITS['derived_from']} THEN 'derivation' END AS layer
    FROM told LEFT JOIN own_best USING (surface) LEFT JOIN origin_best USING (surface)))"""
MARKS_SQL = """m AS MATERIALIZED (
  SELECT document, ordinal, row_number() OVER (PARTITION BY document, ordinal ORDER BY kind DESC, k) AS mark, kind AS reason, text FROM (
    SELECT document, ordinal, 'quoted' AS kind, unnest(q) AS text, unnest(range(len(q))) AS k FROM (SELECT document, ordinal, regexp_extract_all(text, '["“]([^"”\\n]{1,240})["”]', 1) AS q FROM p)
    UNION ALL SELECT document, ordinal, 'italic', unnest(q), unnest(range(len(q))) FROM (SELECT document, ordinal, regexp_extract_all(raw, '(?is)<(?:i|em)\\b[^>]*>(.*?)</(?:i|em)\\s*>', 1) AS q FROM p)))"""
BASE_SQL = f"""{PASSAGES_SQL}, {LEXICON_SQL}, {MARKS_SQL},
{sql_words('w', 'p', 'document, ordinal')}, {sql_words('mw', 'm', 'document, ordinal, mark')}, {LAYERS_SQL}"""


def sql_islands(name: str, source: str, keys: str, texts: str) -> str:
    """Runs of two or more chosen words of ``source`` with nothing but blanks, slashes and hyphens between: first number and surface."""
    return f"""{name} AS (
  SELECT {keys}, min(i) AS i, substr(any_value(text), min(s) + 1, max(e) - min(s)) AS surface FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY i) AS island FROM (
      SELECT *, CASE WHEN lag(i) OVER (PARTITION BY {keys} ORDER BY i) = i - 1 AND regexp_full_match(gap, '[\\s/-]+') THEN 0 ELSE 1 END AS fresh FROM {source}))
  JOIN {texts} USING ({keys}) GROUP BY {keys}, island HAVING count(*) >= 2)"""


STOPS_SQL = "[" + ", ".join(map(sql_text, sorted(build.STOPS))) + "]"
BRIDGES_SQL = "[" + ", ".join(map(sql_text, sorted(build.BRIDGES))) + "]"
#: The only cue in these texts is the verb that the rule has put there, a word by itself.
EVENTS_SQL = f"""cues AS MATERIALIZED (SELECT document, ordinal, s AS a, e AS b FROM w WHERE lower(surface) = 'means'),
chosen AS MATERIALIZED (SELECT w.* FROM w JOIN k USING (surface) WHERE candidate),
{sql_islands('run', 'chosen', 'document, ordinal', 'p')},
pieces AS (SELECT document, ordinal, mark, string_split(lower(p.text), lower(m.text)) AS parts, length(m.text) AS n FROM m JOIN p USING (document, ordinal) WHERE m.text <> ''),
places AS (SELECT document, ordinal, mark, n, sum(length(part) + n) OVER (PARTITION BY document, ordinal, mark ORDER BY j)::INTEGER AS e, j < last AS found
  FROM (SELECT document, ordinal, mark, n, len(parts) AS last, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS j FROM pieces)),
near AS (SELECT DISTINCT document, ordinal, mark FROM places JOIN cues USING (document, ordinal) WHERE found AND (abs(a - e) <= {build.NEAR} OR abs(e - n - b) <= {build.NEAR})),
facts AS MATERIALIZED (
  SELECT m.*, near.mark IS NOT NULL AS defined, count(mw.i) AS words, count(*) FILTER (special) AS odd, count(*) FILTER (candidate) AS unknown
  FROM m LEFT JOIN near USING (document, ordinal, mark) LEFT JOIN mw USING (document, ordinal, mark) LEFT JOIN k ON k.surface = mw.surface GROUP BY ALL),
kinds AS MATERIALIZED (
  SELECT *, CASE WHEN odd = 0 AND NOT defined OR words = 0 THEN 'none' WHEN words <= {build.SPAN} AND (odd IN (0, words) OR defined OR (reason = 'italic' OR words = 2) AND unknown > 0)
    OR (reason = 'italic' OR words = 2) AND words BETWEEN 2 AND {build.MIXED} THEN 'whole' ELSE 'parts' END AS kind FROM facts),
part AS MATERIALIZED (SELECT mw.*, reason FROM kinds JOIN mw USING (document, ordinal, mark) JOIN k ON k.surface = mw.surface WHERE kind = 'parts' AND (special OR odd = 0)),
{sql_islands('part_run', 'part', 'document, ordinal, mark', 'm')},
before AS MATERIALIZED (
  SELECT document, ordinal, a, w.*, row_number() OVER (PARTITION BY document, ordinal, a ORDER BY w.i DESC) AS r, lead(gap) OVER (PARTITION BY document, ordinal, a ORDER BY w.i) AS after
  FROM cues JOIN w USING (document, ordinal) WHERE w.e <= a),
firsts AS (SELECT document, ordinal, a, min(r) AS first FROM before WHERE term NOT IN {BRIDGES_SQL} GROUP BY ALL),
cuts AS (SELECT document, ordinal, a, any_value(first) AS first,
    min(CASE WHEN a - e > {build.NEAR} OR r >= first AND term IN {STOPS_SQL} OR r > first AND regexp_matches(after, '[.!?;:]') THEN r END) AS cut
  FROM before JOIN firsts USING (document, ordinal, a) GROUP BY ALL),
subject AS MATERIALIZED (SELECT before.* FROM before JOIN cuts USING (document, ordinal, a) WHERE r >= first AND r < coalesce(cut, r + 1) AND r < first + {build.SPAN}),
subjects AS (SELECT document, ordinal, min(a) AS a, min(i) AS i, substr(any_value(text), s + 1, e - s) AS surface FROM (
  SELECT document, ordinal, a, min(i) AS i, min(s) AS s, max(e) AS e FROM subject GROUP BY document, ordinal, a HAVING count(*) > 1) JOIN p USING (document, ordinal) GROUP BY document, ordinal, s, e),
close AS (SELECT document, ordinal, i, min(a) AS a, any_value(surface) AS surface FROM (
  SELECT w.document, w.ordinal, w.i, a, w.surface FROM cues JOIN w USING (document, ordinal) JOIN k USING (surface) LEFT JOIN subject x USING (document, ordinal, a, i)
  WHERE w.term NOT IN {STOPS_SQL} AND (candidate OR x.i IS NOT NULL) AND greatest(a - w.e, w.s - b, 0) <= {build.NEAR}) GROUP BY document, ordinal, i),
raw_events AS (
  SELECT document, ordinal, 0 AS pass, i AS x, 0 AS y, 'word' AS kind, surface, ['not_in_english_baseline'] AS reasons, true AS counts, false AS whole FROM chosen WHERE length(term) >= 3
  UNION ALL SELECT document, ordinal, 1, i, 0, 'run', surface, ['multiword_non_english'], true, false FROM run
  UNION ALL SELECT document, ordinal, 2, mark, 0, 'span', text, [reason], false, true FROM kinds WHERE kind = 'whole'
  UNION ALL SELECT document, ordinal, 2, mark, i, 'span', surface, [reason], false, false FROM part
  UNION ALL SELECT document, ordinal, 2, mark, 100000 + part_run.i, 'span', surface, ['multiword_non_english', reason], false, false FROM part_run JOIN m USING (document, ordinal, mark)
  UNION ALL SELECT document, ordinal, 3, a, 0, 'subject', surface, ['definition_context'], false, false FROM subjects
  UNION ALL SELECT document, ordinal, 4, a, i, 'near', surface, ['definition_context'], false, false FROM close),
clean AS (SELECT * REPLACE (trim(regexp_replace(surface, '\\s+', ' ', 'g'), ' .,;:!?()[]{{}}"“”‘’' || chr(9)) AS surface) FROM raw_events),
ev AS MATERIALIZED (SELECT *, trim({sql_normal('surface')}, ' .,;:!?()[]{{}}"“”‘’''') AS term FROM clean WHERE surface <> '')"""

SPANS_SQL = f"WITH {BASE_SQL}, {EVENTS_SQL} SELECT document, ordinal, row_number() OVER (PARTITION BY document, ordinal ORDER BY pass, x, y)::INTEGER AS place, kind, term, surface, array_to_string(list_sort(reasons), ',') AS reasons, whole FROM ev"
ENTRIES_SQL = f"""WITH {BASE_SQL}, {EVENTS_SQL},
first AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY term ORDER BY document, ordinal, pass, x, y) = 1),
spelt AS (SELECT term, surface, sum(counts::INTEGER)::BIGINT AS n FROM ev GROUP BY ALL),
spelt_counts AS (SELECT spelt.term, spelt.surface, n + (first.surface = spelt.surface AND first.whole)::INTEGER AS n, first.surface = spelt.surface AS canonical FROM spelt JOIN first USING (term)),
told_entries AS (SELECT term, max(surface) FILTER (canonical) AS canonical, list(surface ORDER BY surface) FILTER (NOT canonical) AS variants, sum(n)::BIGINT AS frequency, list(surface || ':' || n ORDER BY surface) FILTER (n > 0) AS counts FROM spelt_counts GROUP BY term),
why AS (SELECT term, list_sort(list_distinct(flatten(list(reasons)))) AS reasons, count(DISTINCT document) AS documents FROM ev GROUP BY term),
spots AS (SELECT * FROM (SELECT term, document, ordinal, list_sort(list_distinct(flatten(list(reasons)))) AS reasons FROM ev GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY term ORDER BY document, ordinal) <= 4),
entries AS (SELECT *, list_sum(list_transform(reasons, lambda r: (MAP {{{', '.join(f"'{r}': {n}" for r, n in glossary.WEIGHTS.items())}}})[r])) + least(documents, 5) + least(len(string_split(term, ' ')), 4) AS priority
  FROM told_entries JOIN why USING (term))"""


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.build(marked_conversations(spark, sf_dir), english(spark, sf_dir), **LIMITS)


@query(f"WITH {BASE_SQL} SELECT surface, term, layer, zipf, candidate, special FROM k")
def english_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which layer of the baseline tells each word of the conversations to be English."""
    rows = build.with_marks(marked_conversations(spark, sf_dir))
    return build.layers(build.words_of(rows).select("surface").distinct(), english(spark, sf_dir), **LIMITS)


@query(SPANS_SQL)
def glossary_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event that speaks for a term: words, runs, what marked spans come to, subjects of definitions and words near cues."""
    found = build.observed(marked_conversations(spark, sf_dir), english(spark, sf_dir), **LIMITS)
    place = F.row_number().over(build.Window.partitionBy("document", "ordinal").orderBy("at"))
    return found.select("document", "ordinal", place.alias("place"), "kind", "term", "surface", F.array_join(build.reason_names(F.col("reasons")), ",").alias("reasons"), "whole")


@query(
    f"""{ENTRIES_SQL} SELECT canonical AS canonical_surface_form, term AS normalized_form, coalesce(array_to_string(variants, '|'), '') AS variants, array_to_string(reasons, ',') AS reason_codes,
  priority::BIGINT AS priority_score, documents::BIGINT AS document_count, frequency, coalesce(array_to_string(counts, '|'), '') AS surface_frequency FROM entries"""
)
def glossary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The glossary of all conversations."""
    counts = F.array_sort(F.transform(F.map_entries("surface_frequency"), lambda e: F.struct(e["key"].alias("s"), e["value"].alias("n"))))
    return built(spark, sf_dir).select(
        "canonical_surface_form", "normalized_form", F.array_join("variants", "|").alias("variants"), F.array_join("reason_codes", ",").alias("reason_codes"), "priority_score",
        "document_count", "frequency", F.array_join(F.transform(counts, lambda e: F.concat(e["s"], F.lit(":"), e["n"])), "|").alias("surface_frequency"),
    )


@query(
    f"""{ENTRIES_SQL} SELECT term AS normalized_form, document, ordinal AS paragraph_ordinal, title, anchor, array_to_string(spots.reasons, ',') AS reason_codes,
  CASE WHEN length(flat) <= 480 THEN flat ELSE rtrim(left(flat, 477)) || '...' END AS context
FROM spots JOIN (SELECT document, ordinal, title, anchor, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM p) USING (document, ordinal)"""
)
def glossary_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first places of every entry with what they look like."""
    each = built(spark, sf_dir).select("normalized_form", F.inline("evidence_contexts"))
    return each.withColumn("reason_codes", F.array_join("reason_codes", ","))


@query(f"{ENTRIES_SQL} SELECT row_number() OVER (ORDER BY priority DESC, documents DESC, len(string_split(term, ' ')) DESC, term, canonical)::INTEGER AS place, term AS normalized_form, priority::BIGINT AS priority_score FROM entries ORDER BY place LIMIT 100")
def glossary_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred entries that come first."""
    found = build.in_order(build.entries(build.events(marked_conversations(spark, sf_dir), english(spark, sf_dir), **LIMITS))).limit(100)
    order = build.Window.orderBy(F.desc("priority_score"), F.desc("document_count"), F.desc("tokens"), "normalized_form", "canonical_surface_form")
    return found.withColumn("place", F.row_number().over(order)).select("place", "normalized_form", "priority_score")
