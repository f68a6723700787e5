"""Secrets in documents: a wide candidate pattern, and a random forest that removes false findings.

Everything runs on built-in functions. One pass of the pattern lists a text's candidates; only a text that
has some is split at them, so that each comes with its neighbouring text. The forest judges length, character
make-up and transitions, dictionary coverage, likeness to a path and the neighbouring words; it is evaluated as
one SQL expression over the candidates of a row, so that rows are neither multiplied nor shuffled nor joined.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filled, only

# Shapes of keys that services hand out, and words beside secrets and beside look-alikes.
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|ghu_|glpat-|xox[abpr]-|sk_live_|sk-|rk_live_|AIza|ya29|eyJ|SG[.]|npm_|pypi-|-----BEGIN"
SECRET_WORDS = "passwords?|passwd|pwd|secrets?|tokens?|api[_-]?keys?|access[_-]?keys?|private[_-]?keys?|auth|bearer|credentials?|keys?"
PLAIN_WORDS = "sha1|sha256|md5|checksum|digest|commit|revision|hash|uuid|guid|id|isbn|card|phone|tel|order|invoice|version|etag|build|ref|file|path|url|href|src|page"
DICTIONARY = (
    "about access account admin article author build change check class client cloud code comment config content customer data date default demo device"
    " document domain download dummy email error example file foobar format group hello home html http image index insert internal item journal language"
    " letmein library line link linux list local login mail main manager member message model module month name network news number object office online"
    " order package page parameter part password path payment people person phone photo picture place placeholder player point policy post price print"
    " private process product profile program project public python query question read record release remove report request research result review sample"
    " school search secret section security select server service session setting shop site size software source staff start state status store story"
    " string student style summary support system table target task team test text theme thing thread time title token tool topic type update upload user"
    " value version video view watch website week welcome window word world write year your"
).split()

#: Parts of long words in prose.
SYLLABLES = "ver schaft heit ung tion ment er lich keit in est ando ble con pre ist ge zu ach tre ous ing sch the".split()

#: The candidates: key blocks, signed tokens, credentials in URLs, values assigned to a secret word or after "bearer", and long
#: runs with a digit, with letters of both cases or after a secret word. The first look behind of the assigned values only saves time.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]*(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
    r"|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*)?"
    r"|(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|(?<=://)[^\s/:@]{1,100}:[^\s/@]{3,200}(?=@)"
    r"|(?<=[:=][ \t]{0,2}[\"']?)(?<=(?i:" + SECRET_WORDS + r")[\"']?[ \t]{0,2}[:=][ \t]{0,2}[\"']?)[^\s\"'|;,<>]{6,}"
    r"|(?<=(?i:bearer)[ \t]{1,2}[\"']?)[^\s\"'|;,<>]{6,}"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16})(?:(?=[A-Za-z+/_-]*[0-9]|[A-Z+/_-]*[a-z][a-z+/_-]*[A-Z]|[a-z+/_-]*[A-Z][A-Z+/_-]*[a-z])"
    r"|(?<=(?i:" + SECRET_WORDS + r")[\"']?[ \t]{1,2}(?:(?i:is)[ \t]{1,2})?[\"']?))[A-Za-z0-9+/_-]{16,}={0,2}"
)
#: Characters before and after a candidate that count as its neighbourhood.
BEFORE, AFTER = 40, 20
#: Labelled findings that the forest learns from.
FINDINGS = 4000
TREES, DEPTH, SEED = 20, 7, 8


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def feature_columns(c: Column, before: Column, after: Column) -> dict[str, Column]:
    """The forest's inputs from a candidate and the text before and after it."""
    n = F.greatest(F.length(c), F.lit(1))
    words = F.array_join(F.regexp_extract_all(F.lower(c), F.lit("(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")"), 1), "")
    beside = F.concat(before, F.lit(" "), after)
    return {
        "length": F.least(F.length(c), F.lit(200)).cast("double"),
        "digits": _share(c, "[0-9]"),
        "uppers": _share(c, "[A-Z]"),
        "lowers": _share(c, "[a-z]"),
        "others": _share(c, "[^A-Za-z0-9]"),
        "vowels": _share(c, "[aeiouAEIOU]"),
        "hex": c.rlike("^[0-9a-fA-F]+$").cast("double"),
        "distinct": F.size(F.array_distinct(F.split(F.substring(c, 1, 200), ""))) / F.least(n, F.lit(200)),
        "letter_to_digit": _share(c, "[A-Za-z](?=[0-9])"),
        "digit_to_letter": _share(c, "[0-9](?=[A-Za-z])"),
        "case_changes": _share(c, "[a-z](?=[A-Z])"),
        "vowel_changes": _share(c, "[aeiouAEIOU](?=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])"),
        "dictionary": F.length(words) / n,
        "longest_letters": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z]+)"), 1), F.length)), F.lit(0)) / n,
        "slashes": _share(c, "[/\\\\]"),
        "path": (before.rlike("[/\\\\.~]$") | after.rlike("^(/|\\.[a-z]{1,5}\\b)") | c.rlike("^/|/[^/]*/")).cast("double"),
        "known_prefix": c.rlike("^(" + PREFIXES + ")").cast("double"),
        "assigned": before.rlike("[:=]\\s*[\"']?$").cast("double"),
        "quoted": before.rlike("[\"']$").cast("double"),
        "secret_word_next": before.rlike("(?i)(" + SECRET_WORDS + ")[\"']?\\s*(is|[:=])?\\s*[\"']?$").cast("double"),
        "secret_word": beside.rlike("(?i)(?<![a-z])(" + SECRET_WORDS + ")(?![a-z])").cast("double"),
        "plain_word": before.rlike("(?i)(?<![a-z])(" + PLAIN_WORDS + ")[\"']?\\s*[:=#]?\\s*[\"']?$").cast("double"),
    }


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """``before``, ``candidate``, ``after``, ``label`` and ``kind``: findings of 24 kinds, made by rule from digests of row numbers."""
    h = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 256)
    g = F.sha2(F.concat(F.lit("context"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "[\r\n]", "")
    digits = F.translate(h, "abcdef", "314159")
    word = F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64("id"), F.lit(len(DICTIONARY))) + 1).cast("int"))
    more = F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    several = lambda options, seed: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(options))) + 1).cast("int"))
    third, size = several(DICTIONARY, 3), (F.lit(16) + F.pmod(F.xxhash64("id", F.lit(4)), F.lit(17))).cast("int")
    letters = F.translate(b64, "0123456789+/=", "qXwZkVjBhGtRm")  # of both cases
    long_word = F.concat(*(several(SYLLABLES, 10 + k) for k in range(5)))
    prose = F.concat(F.translate(F.substring(g, 1, 12), "0123456789", "eairtnoshl"), F.lit(" "), F.translate(F.substring(g, 13, 7), "0123456789", "eairtnoshl"), F.lit(" "))
    nothing = F.lit("")
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    some = lambda *options: F.element_at(F.array(*(F.lit(o) for o in options)), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(len(options))) + 1).cast("int"))
    kinds = [  # label, before, candidate, after
        (1, some("", "", "key: ", "AWS_ACCESS_KEY_ID="), join("AKIA", F.upper(some(F.translate(F.substring(h, 1, 16), "0189", "QXWZ"), F.translate(F.substring(h, 1, 16), "0123456789", "QXWZRTYUIO")))), nothing),
        (1, some('token = "', "token: ", 'TOKEN="', "access_token="), F.substring(h, 1, 40), some('"', "", "'")),
        (1, some("password=", "password: ", "passwd=", 'PASSWORD = "'), F.substring(h, 1, 18), some("", '"')),
        (1, some('TOKEN = "', "SECRET=", "API_KEY: "), F.upper(F.substring(h, 1, 40)), some('"', "")),
        (1, some("secret_key = '", 'aws_secret_access_key="', "apikey="), F.substring(b64, 1, 40), some("'", '"', "")),
        (1, some("", "token ", "Authorization: Bearer "), join(some("ghp_", "glpat-", "sk_live_", "npm_"), F.regexp_replace(F.substring(b64, 1, 36), "[+/=]", "x")), nothing),
        (1, some("pwd=", "password=", "secret: "), join(F.initcap(F.substring(word, 1, 4)), F.substring(digits, 1, 4), some("!", "$", "#", "%"), F.substring(b64, 1, 5)), nothing),
        (1, some("key = ", "auth: ", "credential="), F.substring(h, 1, 32), nothing),
        (0, some("", "", "card ", "tel "), F.substring(digits, 1, 16), nothing),
        (0, some("", "in ", "the "), join(word, more, F.substring(digits, 1, 4), some("", "edition", "series")), nothing),
        (0, some("commit ", "sha1: ", "revision ", "index "), F.substring(h, 1, 40), nothing),
        (0, some("id=", "uuid ", "guid: "), join(F.substring(h, 1, 8), "-", F.substring(h, 9, 4), "-", F.substring(h, 13, 4), "-", F.substring(h, 17, 4), "-", F.substring(h, 21, 12)), nothing),
        (0, some("", "path ", "file:"), join("/", word, "/", more, F.substring(digits, 1, 2), "/", word), some("/", ".html", ".py")),
        (0, some("password=", "token: ", 'api_key="'), some("your_password_here1", "changeme_please_01", "xxxxxxxxxxxxxxx1", "example_token_0001", "placeholder-value-1", "<password>", "********"), some("", '"')),
        (0, some("sha256 ", "checksum: ", "md5 ", "etag "), F.substring(h, 1, 64), nothing),
        (1, some("", "in ", 'token = "', "api_key="), letters.substr(F.lit(1), size), nothing),
        (1, some("token ", "key: ", "secret=", "credential is "), F.lower(letters).substr(F.lit(1), size), nothing),
        (1, some("api_key='", 'token="', "Authorization: Bearer ", "access_key: "), b64.substr(F.lit(1), size - 8), some("", "'", '"')),
        (0, some("", "", "the ", "key "), some(F.initcap(long_word), long_word, F.initcap(join(long_word, word)), F.upper(long_word)), some("", ".", ",")),
        (0, some("", "see ", "by ", "token "), join(F.initcap(word), some("", "-", "/", "_"), F.initcap(more), some("", "-", "/", "_"), F.initcap(third)), nothing),
        (0, some("key: ", "secret: ", "auth: ", "bearer ", "token=", "password: "), some(word, word, several(SYLLABLES, 20), join(several(SYLLABLES, 20), several(SYLLABLES, 21)), join(word, "_", more)), some("", ".", "s")),
        (0, some("", "in ", "the "), join(F.initcap(word), F.initcap(more), some(F.initcap(third), third, "")), nothing),
        (0, some("", "of ", "card ", "token "), F.substring(digits, 1, 16), some(" token", ' token = "', " password", " key", ".", "")),
        (0, some("/", "url /", ""), join(word, "-", F.substring(digits, 1, 4), "-", F.substring(digits, 5, 2), "-", more, "-", word), some("", "/", ".html")),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(kinds)))
    pick = lambda k: F.coalesce(*(F.when(kind == i, row[k]) for i, row in enumerate(kinds)))
    return spark.range(rows).select(
        F.right(F.concat(prose, pick(1)), F.lit(BEFORE)).alias("before"), pick(2).alias("candidate"),
        F.left(F.concat(pick(3), F.lit(" "), F.reverse(prose)), F.lit(AFTER)).alias("after"),
        F.coalesce(*(F.when(kind == i, F.lit(float(row[0]))) for i, row in enumerate(kinds))).alias("label"), kind.cast("int").alias("kind"),
    )


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest over ``before``, ``candidate``, ``after`` and ``label`` (1 secret, 0 none) of a bounded table of findings."""
    features = feature_columns(F.col("candidate"), F.col("before"), F.col("after"))
    rows = findings.select(*(F.coalesce(v, F.lit(0.0)).alias(k) for k, v in features.items()), F.col("label").cast("double").alias("label"))
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(rows)


def unseen(findings: DataFrame, kind: int, threshold: float = 0.5) -> tuple[float, int, int]:
    """How a forest judges a kind of findings that it has not learned from: the kind's label, its rows, and how many are told right."""
    forest = train(findings.where(F.col("kind") != kind))
    features = F.array(*(F.coalesce(v, F.lit(0.0)).cast("double") for v in feature_columns(F.col("candidate"), F.col("before"), F.col("after")).values()))
    rows = findings.where(F.col("kind") == kind).select("label", features.alias("f"))
    right = F.count_if((F.expr(as_sql(forest, "f")) >= threshold) == (F.col("label") == 1))
    return tuple(rows.agg(F.first("label"), F.count(F.lit(1)), right).first())


def as_sql(model: RandomForestClassificationModel, features: str) -> str:
    """The forest's probability of a secret as SQL over an array of features: the mean of the trees' leaf shares."""

    def told(node) -> str:  # noqa: ANN001  (a node of Spark's tree)
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return f"{stats[1] / sum(stats)!r}D"
        split = node.split()
        return f"CASE WHEN {features}[{split.featureIndex()}] <= {split.threshold()!r}D THEN {told(node.leftChild())} ELSE {told(node.rightChild())} END"

    trees = [told(tree._java_obj.rootNode()) for tree in model.trees]
    return f"({' + '.join(trees)}) / {len(trees)}"


@lru_cache(maxsize=1)
def _default(session: SparkSession) -> RandomForestClassificationModel:
    return train(labelled_findings(session))


def default_model(spark: SparkSession) -> RandomForestClassificationModel:
    """The forest of the built-in labelled findings; fitted once in a session."""
    return _default(spark)


def judged(rows: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """``rows`` (``row``, ``text``) with the arrays ``found`` (candidate, before, after), ``features`` and ``probability``, one
    entry for each candidate, and ``parts``, the text between candidates. Null where a text has none."""
    out = rows.withColumn("candidates", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    out = out.withColumn("parts", F.when(F.size("candidates") > 0, F.split("text", CANDIDATE, -1)))
    earlier = lambda k: F.concat(F.when(k > 0, F.get("candidates", k - 1)).otherwise(""), F.get("parts", k))
    found = F.transform("candidates", lambda c, k: F.struct(c.alias("candidate"), F.right(earlier(k), F.lit(BEFORE)).alias("before"), F.left(F.get("parts", k + 1), F.lit(AFTER)).alias("after")))
    out = out.withColumn("found", F.when(F.col("parts").isNotNull(), found))
    features = lambda x: feature_columns(x["candidate"], x["before"], x["after"]).values()
    out = out.withColumn("features", F.transform("found", lambda x: F.array(*(F.coalesce(v, F.lit(0.0)).cast("double") for v in features(x)))))
    return out.withColumn("probability", F.expr(f"transform(features, f -> {as_sql(model, 'f')})"))


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per secret: id, ``first`` (0-based character), ``end``, ``kind``, ``secret_sha256``, ``probability``.

    Null and empty texts have none. Repeated rows are scanned as often as they come, null ids are
    kept, texts are scanned whole. A probability equal to the threshold counts. Needs no shuffle.
    """
    rows = only(docs, row=id_col, text=text_col).withColumn("text", filled(F.col("text")))
    names = list(feature_columns(F.lit(""), F.lit(""), F.lit("")))
    has = lambda p, name: F.get(p["features"], F.lit(names.index(name))) == 1
    seen = judged(rows, model or default_model(docs.sparkSession)).where(F.col("parts").isNotNull())
    # where each candidate starts: the lengths of all that stands before it
    starts = F.aggregate("parts", F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(
        F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + F.length(x)
        + F.coalesce(F.length(F.get("candidates", F.size(acc) - 1)), F.lit(0)))))
    seen = seen.withColumn("starts", starts).withColumn("p", F.explode(F.arrays_zip("found", "features", "probability", F.slice("starts", F.lit(1), F.size("found")).alias("first"))))
    p = F.col("p")
    return seen.where(p["probability"] >= threshold).select(
        F.col("row").alias(id_col),
        p["first"].alias("first"),
        (p["first"] + F.length(p["found"]["candidate"])).alias("end"),
        F.when(has(p, "known_prefix"), "service key").when(has(p, "secret_word_next"), "assigned value").otherwise("other").alias("kind"),
        F.sha2(p["found"]["candidate"], 256).alias("secret_sha256"),
        p["probability"].alias("probability"),
    )


def redact(docs: DataFrame, model: RandomForestClassificationModel | None = None, text_col: str = "text", mark: str = "[secret]", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mark``; all columns, rows and other characters stay.

    Null and empty texts stay as they are, an empty table gives no rows, repeated rows are mended alike, texts are
    read whole whatever their length. Columns of any name and type travel along. Needs no shuffle.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    seen = judged(rows, model or default_model(docs.sparkSession))
    mended = F.transform("candidates", lambda c, k: F.concat(F.when(F.get("probability", k) >= threshold, F.lit(mark)).otherwise(c), F.get("parts", k + 1)))
    text = F.when(F.col("parts").isNotNull(), F.concat(F.get("parts", F.lit(0)), F.array_join(mended, ""))).otherwise(F.col("text"))
    seen = seen.select("row", text.alias("text"))
    return seen.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
