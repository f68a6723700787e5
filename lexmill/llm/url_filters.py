"""URL allow and block lists by host-suffix and path-prefix expressions.

Each URL is expanded into all expressions ``host suffix + path prefix`` that some rule could
have (no more labels or path segments than the rules themselves use). Expressions and rules meet
in an equi-join on the first hex digits of their SHA-256; a full digest comparison confirms each
meeting; of the rules that fit, the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Hex digits of a digest that the join compares.
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.coalesce(F.regexp_extract(url.cast("string"), "://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url.cast("string"), "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, most: int) -> Column:
    """The host and its parent domains, of ``most`` labels at most."""
    labels = F.split(host, "\\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))),
        lambda n: F.array_join(F.slice(labels, -n, n), "."),
    )


def path_prefixes(path: Column, most: int) -> Column:
    """The parts of the path that end at one of its first ``most`` slashes."""
    parts = F.split(path, "/", -1)
    depth = F.least(F.size(parts) - 1, F.lit(most))
    return F.when(
        depth >= 1,
        F.transform(F.sequence(F.lit(1), depth), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))),
    ).otherwise(F.array().cast("array<string>"))


def judge(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow"
) -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` (beginning and ending with ``/``) and ``verdict``; a rule fits
    its host and all subdomains if the URL's path starts with the rule's. The longest rule wins; of
    equally long ones the longer host, then ``block`` before ``allow``. URLs that no rule fits, null
    ones and those without ``://`` get a null rule and the verdict ``otherwise``. Repeated rows are
    judged once and returned as often as they came. Spark broadcasts the rules only below
    its own size threshold; else the join shuffles, and AQE splits partitions of frequent expressions.
    """
    r = rules.select("host", "path", "verdict").where(F.col("host").isNotNull() & F.col("path").isNotNull()).distinct()
    shape = r.agg(
        F.max(F.size(F.split("host", "\\.", -1))).alias("labels"),
        F.max(F.size(F.split("path", "/", -1)) - 1).alias("depth"),
        F.max(~(F.col("path").startswith("/") & F.col("path").endswith("/"))).alias("bad"),
    ).first()
    if shape["bad"]:
        raise ValueError("the path of a rule must begin and end with /")
    labels, depth = shape["labels"] or 1, shape["depth"] or 1
    digest = F.sha2(F.concat("host", "path"), 256)
    listed = r.select(
        F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"),
        digest.alias("rule_digest"),
        F.struct(
            F.length(F.concat("host", "path")).alias("n"),
            F.length("host").alias("h"),
            (F.col("verdict") == "block").alias("b"),
            F.concat("host", "path").alias("rule"),
            F.col("verdict").alias("verdict"),
        ).alias("found"),
    )
    urls = only(pages, id=id_col, url=url_col).groupBy("id", "url").agg(F.count(F.lit(1)).alias("copies"))
    expressions = (
        urls.withColumn("host", host_of(F.col("url")))
        .withColumn("path", path_of(F.col("url")))
        .withColumn("suffix", F.explode(host_suffixes(F.col("host"), labels)))
        .withColumn("digests", F.transform(path_prefixes(F.col("path"), depth), lambda p: F.sha2(F.concat("suffix", p), 256)))
        .withColumn("digest", F.explode_outer("digests"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
        .drop("digests", "suffix")
    )
    met = expressions.join(listed, "prefix", "left")
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.col("found"))
    best = met.groupBy("id", "url").agg(
        F.first("host").alias("host"), F.first("path").alias("path"), F.first("copies").alias("copies"), F.max(confirmed).alias("best")
    )
    return best.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"),
    )
