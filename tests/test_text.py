import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import corpus, search
from lexmill.plans import query as P


def test_normal_form_of_all_characters(spark):
    chars = [chr(c) for c in range(1, 0x3000) if unicodedata.category(chr(c)) != "Cs"] + list("ﬁß𝒜İŉ")
    got = spark.createDataFrame([(c,) for c in chars], "c string").select("c", T.normalize(F.col("c")).alias("n")).collect()
    assert [r for r in got if r["n"] != T.plain(r["c"])] == []


def test_words_and_phrases(spark):
    row = spark.createDataFrame([("A a-a É b_c!",)], "t string").select(T.tokens(T.normalize(F.col("t"))).alias("w"), T.occurrences(T.spaced(T.normalize(F.col("t"))), ["a", "a"]).alias("n")).first()
    assert row["w"] == ["a", "a", "a", "e", "b", "c"]
    assert row["n"] == 2


def test_query_parser():
    plan = P.parse("\"in the\" 'of' the \"in the\"")
    assert plan.words == ("in", "the", "of") and plan.phrases == (("in", "the"), ("in", "the"))
    assert P.parse("don't 'a b'").phrases == (("a", "b"),)
    with pytest.raises(P.QueryError):
        P.parse("!!")


def test_scope_and_bounds():
    assert P.scope("all") is None and P.scope("both") == ("en", "de") and P.scope("fr, EN") == ("en", "fr")
    for bad in ("xx", "default+fr", ""):
        with pytest.raises(P.QueryError):
            P.scope(bad)
    assert P.page_range("1-3, 8", 9) == [1, 2, 3, 8] and P.page_range("*", 2) == [1, 2]
    with pytest.raises(P.QueryError):
        P.within(limit=0)
    assert P.distinct_queries(["A  b", "a b", "c"]) == ["A  b", "c"]


def test_natural_order(spark):
    df = spark.createDataFrame([("section-10/chunk-2",), ("section-2/chunk-10",), ("section-2/chunk-9",)], "a string")
    assert [r["a"] for r in df.orderBy(T.natural_key(F.col("a"))).collect()] == ["section-2/chunk-9", "section-2/chunk-10", "section-10/chunk-2"]


def test_page_quality(spark):
    pages = [(0, "word here again\n" * 5), (1, "�"), (2, "an illustration"), (3, None), (4, "a\x01b c d")]
    got = {r["doc_id"]: r for r in corpus.assess_pages(spark.createDataFrame(pages, "doc_id long, text string")).collect()}
    assert got[0]["warnings"] == ["repeated_lines"] and got[0]["repeated_line_ratio"] == 1.0
    assert got[1]["warnings"] == ["replacement_characters", "very_short_output"]
    assert got[2]["status"] == "ok" and got[3]["warnings"] == ["very_short_output"]
    assert got[4]["warnings"] == ["control_characters"]


def passages(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, title string, book string, relative_path string, anchor string, ordinal int, text string")


def test_search_scores_and_snippets(spark):
    p = passages(spark, [(1, "en", "Résumé", "", "a", "s-1", 0, "plain text with résumé inside and more"), (2, "en", "x", "b", "b", "s-1", 0, "resume resume"), (3, "fr", "resume", "b", "c", "s-1", 0, "resume")])
    got = search.search(p, "resume", context=5).collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 1101 + 1), (2, 202)]
    assert got[0]["matched_text"] == "résumé" and got[0]["snippet"] == "... with résumé insi ..." and got[0]["book"] is None
    assert search.search(p, '"resume resume"', context=None).first()["score"] == 100_202


def test_fan_out_merges(spark):
    p = passages(spark, [(1, "en", "t", "", "a", "s-1", 0, "alpha beta"), (2, "en", "t", "", "a", "s-2", 1, "alpha"), (3, "en", "t", "", "b", "s-1", 0, "beta")])
    got = search.fan_out(p, ["alpha", "beta"], max_per_document=1).collect()
    assert [(r["id"], r["query_hits"]) for r in got] == [(1, 2), (3, 1)]
    assert [r["id"] for r in search.fan_out(p, ["alpha", "beta"], max_per_document=0).collect()][:1] == [1]


def test_fuzzy_and_context(spark):
    p = passages(spark, [(i, "en", "t", "", "a", f"s-{i}", i, t) for i, t in enumerate(["meditation here", "other words", "meditation there", "end"])])
    terms = search.roll_up(search.vocabulary(p))
    assert search.corrections(terms, "meditaton now") == ["meditaton now", "meditation now"]
    near = search.around(p, "en:a#s-2", 1).collect()
    assert [(r["id"], r["selected"]) for r in near] == [(1, False), (2, True), (3, False)]


def test_dedupe_winners(spark):
    df = spark.createDataFrame([(1, "k", "a"), (2, "k", "b")], "at int, key string, v string")
    assert search.first_wins(df, ["key"], [F.col("at")]).first()["v"] == "a" and search.last_wins(df, ["key"], "at").first()["v"] == "b"


def test_packing_matches_the_fold(spark):
    df = spark.createDataFrame([(["aaaa", "bbb", "cc", "dddddddddd", "e"],)], "p array<string>")
    got = df.select(corpus.pack(F.col("p"), 8, 1).alias("x")).first()["x"]
    assert [" ".join(x) for x in got] == corpus.greedy(["aaaa", "bbb", "cc", "dddddddddd", "e"], 8) == ["aaaa bbb", "cc", "dddddddddd", "e"]


def test_conversations_and_citations(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "Human", " Hello \nworld"), (1, 2, "tool", "x"), (2, 0, "assistant", "{}")], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["title"] for r in corpus.conversation_titles(turns).collect()} == {1: "Hello", 2: "New conversation"}
    assert [(r["conv_id"], r["turn"]) for r in corpus.renderable(turns).orderBy("conv_id", "turn").collect()] == [(1, 0), (1, 1)]
    cited = corpus.citations(spark.createDataFrame([(1, "see [[en:a/b.md#s-1]] and c/d.md#p0002.")], "id long, text string"), "id").collect()
    assert [(r["source"], r["path"], r["anchor"]) for r in cited] == [("en", "a/b.md", "s-1"), (None, "c/d.md", "p0002")]


def test_books(spark):
    pages = spark.createDataFrame([("b", 2, "complete", "two"), ("b", 1, "complete", "one x"), ("b", 3, "failed", None)], "book string, page_number int, status string, text string")
    book = corpus.assemble_books(pages).first()
    assert book["text"].index("one") < book["text"].index("two") and (book["completed"], book["failed"], book["complete"]) == (2, 1, False)
    assert [r["context"] for r in corpus.page_context(pages, 1).orderBy("page_number").collect()] == [None, "x", "two"]
