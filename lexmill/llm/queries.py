"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cap_filters, conversation_repair, decontaminate, html_extract, metric_tree, order_minhash, quality, secret_scan, spelling, toxicity, url_filters, warc
from .common import crc_fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.round_trip(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    parts = warc.build_index(warc.archive(pages))
    found = warc.lookup(parts, pages.select(warc.url_key(F.col("url")).alias("key"), "page_id"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH digests AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
typed AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM digests)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM typed
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: host, path, verdict
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(str(rule) for rule in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


OP5_SQL = """
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
ranked AS (
  SELECT page_id, host, path, h || p AS rule, coalesce(verdict, 'allow') AS verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, verdict FROM ranked WHERE k = 1
"""


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, machine)
    return scored.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op11_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.top_k(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)::HUGEINT) AS x FROM embeddings
  WHERE list_count(embedding) = len(embedding) AND NOT list_contains(list_transform(embedding, lambda x: isfinite(x)), false)),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, coalesce(list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

#: DuckDB has no CRC-32: a table of the 256 bytes' remainders, folded over the bytes of a text.
CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs)"""


def crc_sql(text: str) -> str:
    """SQL for the CRC-32 of ``text`` (letters up to U+00FF), where ``crc_table`` is joined."""
    codes = f"flatten(list_transform(string_split({text}, ''), lambda s: CASE WHEN ord(s) < 128 THEN [ord(s)] ELSE [192 | (ord(s) >> 6), 128 | (ord(s) & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}::BIGINT[]), lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295)"


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


#: Near words by letters left out: two words of one length agree without the letter at one place, a longer one is the shorter without one.
OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
told AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, k, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM told, crc_table),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
less AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INTEGER AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS best, max(m) AS best_n FROM pairs GROUP BY word),
forms AS MATERIALIZED (
  SELECT words.word, n, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END::BIGINT AS form_n, coalesce(n_near, 0)::BIGINT AS n_near
  FROM words LEFT JOIN near ON near.word = words.word),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT chain.word, form FROM chain JOIN forms ON forms.word = root WHERE form IS NOT NULL),
ends AS (SELECT chain.word, root FROM chain JOIN forms ON forms.word = root WHERE form IS NULL)
SELECT forms.word, n, form, form_n, n_near, root FROM forms JOIN ends ON ends.word = forms.word
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audit(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def _walked() -> str:
    """SQL for the four states after a row: cheapest audit and text of each, then of those with turns inserted."""
    line = "chr(10) || role || ':' || text"

    def to(state: int, cost: str, letter: str, text: str = "''") -> str:
        return f"{{'c': s{state}.c + {cost}, 'a': s{state}.a || '{letter}', 't': s{state}.t || {text}}}"

    kept = lambda state, initial: to(state, f"CASE WHEN fault IN ('blank', 'duplicate') OR left(role, 1) <> '{initial}' THEN 1000000 ELSE more END", "K", line)
    reroled = lambda state, role: to(state, "CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 ELSE more + 1 END", "R", f"chr(10) || '{role}:' || text")
    moves: dict[int, list[str]] = {k: [to(k, "2", "D")] for k in range(4)}
    moves[1].append(kept(0, "s"))
    for state in (0, 1, 3):
        moves[2] += [kept(state, "u"), reroled(state, "user")]
    moves[3] += [kept(2, "a"), reroled(2, "assistant")]
    return ", ".join(f"list_min([{', '.join(m)}]) AS s{k}" for k, m in moves.items())


INSERTED = "{{'c': s{0}.c + 5, 'a': s{0}.a || 'I', 't': s{0}.t || chr(10) || '{1}:'}}"
USERS = f"list_min([s2, {INSERTED.format(0, 'user')}, {INSERTED.format(1, 'user')}, {INSERTED.format(3, 'user')}])"
NEVER = "{'c': 1000000::BIGINT, 'a': '', 't': ''}"
OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hashed AS (SELECT *, {crc_sql("name")} % 20 AS kind FROM given, crc_table),
rows_after AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM hashed WHERE kind <> 0)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows_after),
faults AS MATERIALIZED (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two,
         CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more
  FROM numbered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faults GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, {NEVER} AS s1,
         {{'c': 5::BIGINT, 'a': 'I', 't': chr(10) || 'user:'}} AS s2, {{'c': 10::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3 FROM counts
  UNION ALL
  SELECT conv_id, i, s0, s1, u AS s2, list_min([s3, {{'c': u.c + 5, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}}]) AS s3
  FROM (SELECT *, {USERS} AS u FROM (
    SELECT walk.conv_id, faults.i, {_walked()} FROM walk JOIN faults ON faults.conv_id IS NOT DISTINCT FROM walk.conv_id AND faults.i = walk.i + 1))),
ends AS (SELECT counts.*, list_min([s0, s3]) AS e FROM walk JOIN counts ON walk.conv_id IS NOT DISTINCT FROM counts.conv_id AND walk.i = counts.n)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(e.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_url_filters": op5_url_filters,
    "op6_html_text": op6_html_text,
    "op7_order_minhash": op7_order_minhash,
    "op8_secret_scan": op8_secret_scan,
    "op9_cap_filters": op9_cap_filters,
    "op10_quality": op10_quality,
    "op11_metric_tree": op11_metric_tree,
    "op12_spelling": op12_spelling,
    "op13_conversation_repair": op13_conversation_repair,
}

#: All pairs; for tables of tests only.
OP9_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE list_count(embedding) = len(embedding) AND NOT list_contains(list_transform(embedding, lambda x: isfinite(x)), false) AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(DISTINCT y) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.x = vec_id LEFT JOIN counts ON counts.x = vec_id
"""

ORACLE: dict[str, str] = {"op2_warc": OP2_SQL, "op5_url_filters": OP5_SQL, "op9_cap_filters": OP9_SQL, "op11_metric_tree": OP11_SQL, "op12_spelling": OP12_SQL, "op13_conversation_repair": OP13_SQL}
