"""Further registered queries over the driver tables: validation of connections, themes and findings, glossary forms, labels, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import glossary, graph, packing, search
from .queries import ORACLE, ROLE_SQL, VOCABULARY_SQL, passages, query, sql_normal, sql_text, table

# --- connections and themes ----------------------------------------------------------------


def pick(options: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (number % len(options) + 1).cast("int"))


def sql_pick(options: tuple[str, ...], number: str) -> str:
    return f"([{', '.join(map(sql_text, options))}])[({number} % {len(options)} + 1)::INTEGER]"


TYPES, SURE = (*graph.CONNECTION_TYPES, "parallels", "illustrates"), (*graph.CONFIDENCES, "low")
#: Neighbouring documents as claims that a connection links; some rows are wrong in one way or another, some come again.
LINKS_SQL = f"""d AS (SELECT a.doc_id AS k, a.source || '#' || a.doc_id AS one, coalesce(b.source || '#' || b.doc_id, 'none#0') AS other
  FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1),
made AS (SELECT k, CASE WHEN k % 5 = 0 THEN [one, one] WHEN k % 7 = 0 THEN [one, 'x#y'] WHEN k % 13 = 0 THEN [one] ELSE [one, other] END AS claim_ids,
  {sql_pick(TYPES, 'k')} AS type, {sql_pick(SURE, 'k')} AS confidence, CASE WHEN k % 11 = 0 THEN ' ' ELSE 'about ' || k END AS summary,
  CASE WHEN k % 17 = 0 THEN NULL ELSE 'since ' || k END AS explanation, CASE WHEN k % 19 = 0 THEN '' ELSE 'Theme ' || k END AS label FROM d),
links AS (SELECT k AS position, * FROM made UNION ALL SELECT k + 1000000 AS position, * FROM made WHERE k % 6 = 1),
facts AS (SELECT *, len(claim_ids) AS n, list_has_any(claim_ids, ['x#y', 'none#0']) AS strange, len(list_distinct(claim_ids)) AS unique_ids,
  len(list_distinct(list_transform(claim_ids, lambda x: split_part(x, '#', 1)))) AS documents FROM links)"""
COMMON_SQL = "WHEN n < 2 THEN 'fewer than two claims' WHEN strange THEN 'unknown claim' WHEN unique_ids < 2 THEN 'only one unique claim' WHEN documents < 2 THEN 'within one document' WHEN trim(summary) = '' THEN 'no summary'"


def links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.concat_ws("#", "source", "doc_id").alias("one"))
    after = docs.select((F.col("k") - 1).alias("k"), F.col("one").alias("other"))
    k = F.col("k")
    ids = F.when(k % 5 == 0, F.array("one", "one")).when(k % 7 == 0, F.array(F.col("one"), F.lit("x#y"))).when(k % 13 == 0, F.array("one")).otherwise(F.array("one", F.coalesce("other", F.lit("none#0"))))
    made = docs.join(after, "k", "left").select(
        "k", ids.alias("claim_ids"), pick(TYPES, k).alias("type"), pick(SURE, k).alias("confidence"), F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("about "), k)).alias("summary"),
        F.when(k % 17 != 0, F.concat(F.lit("since "), k)).alias("explanation"), F.when(k % 19 == 0, "").otherwise(F.concat(F.lit("Theme "), k)).alias("label"),
    )
    rows = made.withColumn("position", k).unionByName(made.where(k % 6 == 1).withColumn("position", k + 1_000_000))
    return rows, docs.select(F.col("one").alias("claim_id"))


CONNECTIONS_SQL = f"""WITH {LINKS_SQL},
judged AS (SELECT *, CASE WHEN type NOT IN ({', '.join(map(sql_text, graph.CONNECTION_TYPES))}) THEN 'unsupported type' {COMMON_SQL}
  WHEN coalesce(trim(explanation), '') = '' THEN 'no explanation' WHEN confidence NOT IN ({', '.join(map(sql_text, graph.CONFIDENCES))}) THEN 'unsupported confidence' END AS first FROM facts),
told AS (SELECT *, coalesce(first, CASE WHEN row_number() OVER (PARTITION BY first IS NULL, type, list_sort(list_distinct(claim_ids)) ORDER BY position) > 1 THEN 'repeats an earlier one' END) AS reason FROM judged)"""


@query(f"{CONNECTIONS_SQL} SELECT position, reason FROM told")
def connection_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.judge_connections(*links(spark, sf_dir)).select("position", "reason")


@query(f"{CONNECTIONS_SQL} SELECT reason, count(*)::BIGINT AS rows FROM told GROUP BY reason")
def connection_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.counters(graph.judge_connections(*links(spark, sf_dir)))


@query(f"{CONNECTIONS_SQL} SELECT position, 'conn-' || lpad((row_number() OVER (ORDER BY position))::VARCHAR, greatest(3, length((row_number() OVER (ORDER BY position))::VARCHAR))::INTEGER, '0') AS connection_id, type, summary, explanation, array_to_string(claim_ids, ',') AS claims FROM told WHERE reason IS NULL")
def connections_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.validate_connections(*links(spark, sf_dir)).select("position", "connection_id", "type", "summary", "explanation", F.array_join("claim_ids", ",").alias("claims"))


@query(
    f"""WITH {LINKS_SQL}, judged AS (SELECT *, CASE WHEN trim(label) = '' THEN 'no label' {COMMON_SQL} END AS first FROM facts),
told AS (SELECT *, coalesce(first, CASE WHEN row_number() OVER (PARTITION BY first IS NULL, lower(trim(label)), list_sort(list_distinct(claim_ids)) ORDER BY position) > 1 THEN 'repeats an earlier one' END) AS reason FROM judged)
SELECT position, 'theme-' || lpad((row_number() OVER (ORDER BY position))::VARCHAR, greatest(3, length((row_number() OVER (ORDER BY position))::VARCHAR))::INTEGER, '0') AS theme_id, label FROM told WHERE reason IS NULL"""
)
def themes_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.validate_themes(*links(spark, sf_dir)).select("position", "theme_id", "label")


@query(f"WITH {LINKS_SQL} SELECT count(DISTINCT claim_id)::BIGINT AS claims FROM (SELECT unnest(claim_ids) AS claim_id FROM links WHERE position % 2 = 0 UNION ALL SELECT unnest(claim_ids) FROM links WHERE position % 3 = 0)")
def claims_in_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = links(spark, sf_dir)
    return graph.claims_in_graph(*(rows.where(F.col("position") % n == 0).select(F.explode("claim_ids").alias("claim_id")) for n in (2, 3)))


ACCEPTED_SQL = f"""{CONNECTIONS_SQL},
linked AS (SELECT 'conn-' || lpad((row_number() OVER (ORDER BY position))::VARCHAR, greatest(3, length((row_number() OVER (ORDER BY position))::VARCHAR))::INTEGER, '0') AS connection_id, type, list_distinct(claim_ids) AS ids FROM told WHERE reason IS NULL),
labelled AS (SELECT *, CASE WHEN trim(label) = '' THEN 'no label' {COMMON_SQL} END AS flaw FROM facts),
settled AS (SELECT *, coalesce(flaw, CASE WHEN row_number() OVER (PARTITION BY flaw IS NULL, lower(trim(label)), list_sort(list_distinct(claim_ids)) ORDER BY position) > 1 THEN 'again' END) AS against FROM labelled),
themed AS (SELECT 'theme-' || lpad((row_number() OVER (ORDER BY position))::VARCHAR, greatest(3, length((row_number() OVER (ORDER BY position))::VARCHAR))::INTEGER, '0') AS theme_id, list_distinct(claim_ids) AS ids FROM settled WHERE against IS NULL)"""


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents as claims, with the accepted connections and themes over them."""
    rows, _ = links(spark, sf_dir)
    claims = passages(spark, sf_dir).select(
        F.concat_ws("#", "book", "id").alias("claim_id"), F.concat(F.lit("said in "), F.coalesce("source", F.lit("none"))).alias("statement"), F.lit(None).cast("string").alias("quote"), F.col("book").alias("document_id"),
        F.when(F.col("id") % 3 == 0, "p0001").otherwise("none").alias("passage_id"), F.concat("source", F.lit(":"), "relative_path", F.lit("#"), F.when(F.col("id") % 2 == 0, F.col("anchor")).otherwise("gone")).alias("citation"),
    )
    return graph.cited(claims), graph.validate_connections(rows, claims), graph.validate_themes(rows, claims)


@query(
    f"""WITH {ACCEPTED_SQL.removeprefix('WITH ')}, e AS (SELECT connection_id, unnest(ids) AS claim_id FROM linked WHERE type = 'supports')
SELECT connection_id, 1 + count_if(lang = 'en')::BIGINT AS score, count(*)::BIGINT AS claims FROM e JOIN documents ON claim_id = source || '#' || doc_id
GROUP BY connection_id HAVING count_if(lang = 'en') > 0 ORDER BY score DESC, connection_id LIMIT 50"""
)
def connection_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, connections, _ = graph_tables(spark, sf_dir)
    return graph.connections_of(connections, claims, "supports en", limit=50).select("connection_id", "score", F.size("claims").cast("long").alias("claims"))


@query(
    f"""WITH {ACCEPTED_SQL.removeprefix('WITH ')}, e AS (SELECT theme_id, unnest(ids) AS claim_id FROM themed)
SELECT theme_id, 1 + count_if(lang = 'de')::BIGINT AS score FROM e JOIN documents ON claim_id = source || '#' || doc_id
GROUP BY theme_id HAVING count_if(lang = 'de') > 0 AND count_if(lang IN ('en', 'de')) = count(*) ORDER BY score DESC, theme_id LIMIT 50"""
)
def theme_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, _, themes = graph_tables(spark, sf_dir)
    return graph.themes_of(themes, claims, "theme de", where="default", limit=50).select("theme_id", "score")


@query(
    f"""WITH {ACCEPTED_SQL.removeprefix('WITH ')}, named AS (SELECT unnest(ids) AS claim_id FROM linked UNION SELECT unnest(ids) FROM themed)
SELECT (SELECT count(*) FROM documents)::BIGINT AS claims, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)::BIGINT AS with_passage,
  (SELECT count(*) FROM linked)::BIGINT AS connections, (SELECT count(*) FROM themed)::BIGINT AS themes, (SELECT count(*) FROM named)::BIGINT AS claims_in_graph, 0::BIGINT AS unknown_claims"""
)
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_stats(*graph_tables(spark, sf_dir), passages(spark, sf_dir))


@query(ORACLE["search_and_terms"])
def search_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over a corpus that holds every passage twice: the first id of equal texts under one anchor stays."""
    rows = passages(spark, sf_dir)
    return search.search(rows.unionByName(rows.withColumn("id", F.col("id") + 10**9)), "the of in", limit=20, context=None, distinct=True)


# --- audit ---------------------------------------------------------------------------------

ASKED, HOW_SURE = ("remove_ordinary_english", "remove_ordinary_english", "keep"), ("high", "medium", "low", "certain")
FINDINGS_SQL = f"""f AS (SELECT doc_id AS position, doc_id % 400 AS candidate_number, {sql_pick(ASKED, 'doc_id')} AS action, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE 'word ' || doc_id END AS reason, {sql_pick(HOW_SURE, 'doc_id')} AS confidence FROM documents),
g AS (SELECT *, CASE WHEN action <> 'remove_ordinary_english' THEN 'unknown action' WHEN trim(reason) = '' THEN 'no reason' WHEN confidence = 'certain' THEN 'unknown confidence' END AS flaw FROM f),
h AS (SELECT *, CASE WHEN candidate_number >= 300 THEN 'unknown candidate' WHEN coalesce(max((flaw IS NULL)::INTEGER) OVER (PARTITION BY candidate_number ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'repeated candidate' ELSE flaw END AS warning FROM g)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    rows = docs.select(k.alias("position"), (k % 400).alias("candidate_number"), pick(ASKED, k).alias("action"), F.when(k % 10 == 0, " ").otherwise(F.concat(F.lit("word "), k)).alias("reason"), pick(HOW_SURE, k).alias("confidence"))
    return packing.audit_findings(rows, docs.where("doc_id < 300").select(k.alias("candidate_number")))


@query(f"WITH {FINDINGS_SQL} SELECT position, candidate_number, warning FROM h")
def finding_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("position", "candidate_number", "warning")


@query(f"WITH {FINDINGS_SQL} SELECT action, count(*)::BIGINT AS findings FROM h WHERE warning IS NULL GROUP BY action")
def finding_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.action_counts(findings(spark, sf_dir))


# --- glossary ------------------------------------------------------------------------------

REASONS = tuple(glossary.WEIGHTS)


@query(
    "SELECT doc_id, (" + " + ".join(f"CASE WHEN (doc_id // {2 ** i}) % 2 = 1 THEN {glossary.WEIGHTS[r]} ELSE 0 END" for i, r in enumerate(REASONS)) + " + least(doc_id % 9, 5) + least(doc_id % 6, 4))::BIGINT AS priority FROM documents"
)
def glossary_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    reasons = F.array_compact(F.array(*(F.when(F.floor(k / 2**i) % 2 == 1, r) for i, r in enumerate(REASONS))))
    return table(spark, sf_dir, "documents").select("doc_id", glossary.priority(reasons, (k % 9).cast("int"), (k % 6).cast("int")).alias("priority"))


def sql_forms(rules: tuple[tuple[str, str, int], ...], word: str = "w") -> str:
    return ", ".join(f"CASE WHEN ends_with({word}, '{s}') AND length({word}) >= {n} THEN left({word}, length({word}) - {len(s)}) || '{put}' END" for s, put, n in rules)


TERMS_SQL = f"w AS (SELECT DISTINCT unnest(regexp_extract_all({sql_normal('text')}, '[a-z]+')) AS w FROM documents)"


def ascii_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(T.normalize(F.col("text")), F.lit("[a-z]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.explode(found).alias("w")).distinct()


@query(
    f"""WITH {TERMS_SQL}, m AS (SELECT MAP {{{', '.join(f"'{a}': '{b}'" for a, b in glossary.IRREGULAR.items())}}} AS bases)
SELECT w AS term, array_to_string(list_sort(list_distinct(list_filter([w, bases[w], {sql_forms(glossary.SUFFIXES)}], lambda x: x IS NOT NULL))), ',') AS forms FROM w, m"""
)
def lookup_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ascii_terms(spark, sf_dir).select(F.col("w").alias("term"), F.array_join(F.array_sort(glossary.lookup_forms(F.col("w"))), ",").alias("forms"))


@query(f"WITH {TERMS_SQL} SELECT w AS term, array_to_string(list_sort(list_distinct(list_filter([{sql_forms(glossary.DERIVED)}], lambda x: x IS NOT NULL AND x <> w))), ',') AS forms FROM w WHERE length(w) >= 7")
def derived_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ascii_terms(spark, sf_dir).where("length(w) >= 7").select(F.col("w").alias("term"), F.array_join(F.array_sort(glossary.derived_forms(F.col("w"))), ",").alias("forms"))


BASES_SQL = f"MAP {{{', '.join(f"'{a}': '{b}'" for a, b in glossary.IRREGULAR.items())}}}"

ORACLE["glossary_terms"] = rf"""WITH base AS MATERIALIZED (SELECT term AS word FROM ({VOCABULARY_SQL}) GROUP BY term HAVING sum(document_frequency) * 50 >= (SELECT count(*) FROM documents)),
s AS (SELECT doc_id, unnest(regexp_extract_all(text, {sql_text(glossary.TERM)})) AS surface FROM documents),
c AS (SELECT doc_id, surface, count(*) AS n FROM s GROUP BY ALL),
u AS MATERIALIZED (SELECT surface, {sql_normal('surface')} AS term FROM (SELECT DISTINCT surface FROM c) WHERE regexp_matches(surface, '\p{{L}}')),
d AS (SELECT term, doc_id, sum(n) AS n FROM c JOIN u USING (surface) WHERE length(term) >= 3 GROUP BY ALL),
g AS MATERIALIZED (SELECT term, frequency, documents, surfaces FROM (SELECT term, sum(n)::BIGINT AS frequency, count(*)::BIGINT AS documents FROM d GROUP BY term) JOIN (SELECT term, count(*)::INTEGER AS surfaces FROM u GROUP BY term) USING (term)),
f AS (SELECT term, unnest(list_filter([term, b[term], {sql_forms(glossary.SUFFIXES, 'term')}], lambda x: x IS NOT NULL)) AS form FROM g, (SELECT {BASES_SQL} AS b)),
e AS MATERIALIZED (SELECT DISTINCT term FROM f SEMI JOIN base ON form = word)
SELECT term, frequency, documents, surfaces, ({glossary.WEIGHTS['not_in_english_baseline']} + least(documents, 5) + 1)::BIGINT AS priority FROM g ANTI JOIN e USING (term)"""

ORACLE["renderable_messages"] = rf"""SELECT * FROM conversations WHERE {ROLE_SQL} <> 'tool' AND trim(text) <> '' AND NOT regexp_matches(trim(text), '^(?:\{{.*\}}|\[\{{.*\}}\])$')
  AND NOT regexp_matches(lower(trim(text)), '^(?:tool|trace|debug|exec):')"""


@query(
    rf"""WITH s AS (SELECT unnest(regexp_extract_all(text, {sql_text(glossary.TERM)})) AS surface FROM documents), c AS (SELECT surface, count(*) AS n FROM s GROUP BY surface)
SELECT {sql_normal('surface')} AS term, array_to_string(list_sort(list(surface || ':' || n)), '|') AS surfaces, sum(n)::BIGINT AS frequency FROM c GROUP BY ALL"""
)
def surface_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, counts = glossary.surface_frequency(table(spark, sf_dir, "documents")), F.col("surface_frequency")
    each = F.transform(F.map_entries(counts), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return found.select("term", F.array_join(F.array_sort(each), "|").alias("surfaces"), F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x).alias("frequency"))


FLAT = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(
    rf"""SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''))::BIGINT AS words,
  CASE WHEN length({FLAT}) <= 480 THEN {FLAT} ELSE rtrim(left({FLAT}, 477)) || '...' END AS excerpt, 'g_' || left(sha256(coalesce(text, '')), 20) AS key, round_even(length(coalesce(text, '')) / 4, 0)::BIGINT AS rough_tokens FROM documents"""
)
def document_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.words_in(text).alias("words"), glossary.excerpt(text).alias("excerpt"), glossary.candidate_key(text).alias("key"), T.rough_tokens(text).alias("rough_tokens"))


# --- labels and clean-up -------------------------------------------------------------------

ANCHOR_SQL = "CASE doc_id % 4 WHEN 0 THEN 'section-' || doc_id % 9 || '/chunk-' || doc_id % 5 WHEN 1 THEN 'Section-' || doc_id WHEN 2 THEN doc_id::VARCHAR ELSE 'some_old--place' || doc_id END"


@query(
    f"""WITH a AS (SELECT doc_id, {ANCHOR_SQL} AS anchor, doc_id % 3 = 0 AS numbered FROM documents)
SELECT doc_id, CASE WHEN NOT numbered AND doc_id % 4 = 0 THEN 'section ' || doc_id % 9 || ', excerpt ' || doc_id % 5 WHEN NOT numbered AND doc_id % 4 = 1 THEN 'section ' || doc_id
  WHEN doc_id % 4 = 2 THEN 'paragraph ' || doc_id ELSE 'source location ' || regexp_replace(anchor, '[-_]+', ' ', 'g') END AS label FROM a"""
)
def place_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(ANCHOR_SQL.replace("::VARCHAR", "").replace("THEN doc_id", "THEN CAST(doc_id AS STRING)")).alias("anchor")).select("doc_id", T.place_label(F.col("anchor"), F.col("doc_id") % 3 == 0).alias("label"))


PAGE_SQL = r"regexp_replace(regexp_replace('<!-- PDF page : 3 -->' || chr(10) || '# Page 4 #' || chr(10) || coalesce(text, '') || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || 'page: 12', '(?i)<!--\s*(?:pdf\s+)?page\s*:\s*\d+\s*-->', '', 'g'), '(?im)^[ \t]*(?:#{1,6}[ \t]+)?(?:pdf[ \t]+)?page(?:[ \t]*:[ \t]*|[ \t]+)\d+[ \t]*#?[ \t]*(?:\n|\z)', '', 'g')"


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({PAGE_SQL}, '[ \t]+(\n|\z)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS page FROM documents")
def page_marks_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("<!-- PDF page : 3 -->\n# Page 4 #\n"), F.coalesce("text", F.lit("")), F.lit("  \n\n\n\npage: 12"))
    return table(spark, sf_dir, "documents").select("doc_id", T.without_page_marks(page).alias("page"))


SCREEN_SQL = "chr(27) || ']0;title' || chr(7) || chr(27) || '[31m' || text || chr(27) || '[0m' || chr(27) || '(1' || chr(13) || chr(8) || 'end'"


@query(rf"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({SCREEN_SQL}, '(?s)\x1b\].*?(?:\x07|\x1b\\)', '', 'g'), '\x1b\[[0-?]*[ -/]*[@-~]', '', 'g'), '\x1b\([0-2]', '', 'g'), '(?s)\x1b[^\x20-\x7e]', '', 'g'), '\r', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS text FROM conversations")
def terminal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    screen = F.concat(F.lit("\x1b]0;title\x07\x1b[31m"), F.col("text"), F.lit("\x1b[0m\x1b(1\r\x08end"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_controls(screen).alias("text"))


STARRED_SQL = "'**' || left(text, 12) || '** and *' || substr(text, 13, 9) || '* or ** **'"


@query(
    rf"""WITH p AS (SELECT conv_id, turn, regexp_extract_all({STARRED_SQL}, '\*\*([^*\n]+?)\*\*|\*([^*\n]+?)\*', 1) AS b, regexp_extract_all({STARRED_SQL}, '\*\*([^*\n]+?)\*\*|\*([^*\n]+?)\*', 2) AS i FROM conversations),
e AS (SELECT conv_id, turn, list_transform(range(1, len(b) + 1), lambda k: CASE WHEN coalesce(b[k], '') <> '' THEN 'bold:' || b[k] ELSE 'italic:' || i[k] END) AS parts FROM p)
SELECT conv_id, turn, array_to_string(list_filter(parts, lambda x: trim(split_part(x, ':', 2) || substr(x, 8)) <> ''), '|') AS parts FROM e"""
)
def message_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    starred = F.concat(F.lit("**"), F.left("text", F.lit(12)), F.lit("** and *"), F.substring("text", 13, 9), F.lit("* or ** **"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(T.emphasis(starred), lambda p: F.concat_ws(":", p["kind"], p["text"])), "|").alias("parts"))


@query(
    r"""WITH b AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x <> '') AS blocks FROM documents)
SELECT doc_id, len(list_filter(range(1, len(blocks) + 1), lambda i: i = 1 OR regexp_replace(blocks[i], '\s+', ' ', 'g') <> regexp_replace(blocks[i - 1], '\s+', ' ', 'g')))::BIGINT AS blocks FROM b"""
)
def distinct_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines stay when those that repeat the line before go."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.distinct_neighbours(F.split(F.coalesce("text", F.lit("")), "\n"))).cast("long").alias("blocks"))


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Authorization: Bearer <redacted>, x' WHEN 1 THEN 'access_token = <redacted>&b=1' WHEN 2 THEN 'API-KEY:<redacted>; y' ELSE 'token: k' || doc_id END AS message,
  CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN '"' || source ELSE source || ' ' || lang END AS name FROM documents"""
)
def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in error texts give way to a mark; quotes around a whole name go."""
    k, value = F.col("doc_id"), F.concat(F.lit("k"), F.col("doc_id"))
    text = F.when(k % 4 == 0, F.concat(F.lit("Authorization: Bearer "), value, F.lit(", x"))).when(k % 4 == 1, F.concat(F.lit("access_token = "), value, F.lit("&b=1"))).when(k % 4 == 2, F.concat(F.lit("API-KEY:"), value, F.lit("; y"))).otherwise(F.concat(F.lit("token: "), value))
    name = F.when(k % 3 == 0, F.concat(F.lit('" '), F.col("lang"), F.lit('  "'))).when(k % 3 == 1, F.concat(F.lit('"'), F.col("source"))).otherwise(F.concat(F.lit("'"), F.col("source"), F.lit("  "), F.col("lang"), F.lit("'")))
    return table(spark, sf_dir, "documents").select("doc_id", T.redact_keys(text).alias("message"), T.unquoted(name).alias("name"))
