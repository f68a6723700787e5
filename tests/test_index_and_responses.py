"""The inverted index against the scan, the evidence form against its definition, responses, resuming, front matter of pages."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.corpus import Corpus
from lexmill.functions import text as T
from lexmill.operators import graph, responses, search

WORDS = ["the", "of", "ferry", "Éclair", "eclair", "straße", "strasse", "한국", "two-part", "x", "harbour", "ﬁsh"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(1)
    rows = [
        (r.choice("ab"), f"D{k // 4 % 9}/{'Ab'[k % 2]}.html", " ".join(r.choices(WORDS, k=2)), r.choice(["", "the ferry", "한국 book"]), f"section-{k % 12}/chunk-{k}", k, " ".join(r.choices(WORDS, k=r.randint(0, 30))) + r.choice(["", ".", "!"]))
        for k in range(150)
    ]
    rows += [rows[3][:5] + (1000, rows[3][6].upper()), ("b", "none.html", "", "", "", 0, "")]
    made = Corpus(spark, str(tmp_path_factory.mktemp("corpus")) + "/c")
    made.store(spark.createDataFrame(rows, "source string, relative_path string, title string, book string, anchor string, ordinal int, text string"))
    return made


@pytest.mark.parametrize("query", ["the", "ferry of the", '"the ferry"', '"of the" and "the of"', "eclair", '"the the the"', "한국", "STRASSE harbour", "nowhere", "the nowhere", '"two part"', "fish x"])
def test_index_gives_what_the_scan_gives(corpus, query):
    for options in ({"limit": 5}, {"limit": 40, "where": "b"}, {"limit": 7, "book": "ferry"}, {"limit": 3, "title": "한"}):
        options = {"where": "all", **options}
        mine = corpus.search(query, **options).collect()
        scan = search.search(corpus.passages(), query, corpus.scope(options.pop("where")), **options).orderBy("rank").collect()
        assert mine == scan


def test_ids_have_no_gaps_and_first_wins(corpus):
    rows = corpus.passages().orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, 152))
    assert [(r["source"], r["relative_path"].lower()) for r in rows] == sorted((r["source"], r["relative_path"].lower()) for r in rows)


def test_terms_are_those_of_the_passages(corpus):
    want = {tuple(r) for r in search.vocabulary(corpus.passages()).select("source", "term", "document_frequency", "term_frequency").collect()}
    assert {tuple(r) for r in corpus.terms().select("source", "term", "document_frequency", "term_frequency").collect()} == want


def test_a_search_reads_its_terms_folders_only(spark, corpus):
    from lexmill.operators import postings

    for word in ("ferry", "harbour"):
        files = {r[0] for r in postings.of_term(corpus.postings(), word).select(F.input_file_name()).distinct().collect()}
        number = spark.range(1).select(postings.bucket(F.lit(word))).first()[0]
        assert files and all(f"/bucket={number}/" in f for f in files)
        plan = postings.of_term(corpus.postings(), word)._jdf.queryExecution().executedPlan().toString()
        assert f"(bucket#" in plan and "PartitionFilters: [isnotnull(bucket" in plan and f"EqualTo(term,{word})" in plan


def test_evidence_form_equals_its_definition(spark):
    r = random.Random(2)
    pool = [chr(c) for c in (*range(32, 127), *range(0xA0, 0x250), *range(0x300, 0x370), *range(0x1100, 0x1120), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3), *range(0xAC00, 0xAC40), *range(0xFB00, 0xFB07), *range(0xFF21, 0xFF3B), *range(0x9B0, 0x9D8), *range(0x2018, 0x201F), 0x130, 0x1E9E, 0x3F4, 0x212B, 0x1F88, 0x13A0, 0xAB70, 0x10400)]
    texts = ["", "plain", "ß ﬀ", "Å", "각", "ো", "ΣΑΣ", "don’t “do” it now"] + ["".join(r.choices(pool, k=r.randint(1, 25))) for _ in range(800)] + [chr(c) for c in range(0x80, 0x3000)]

    def wanted(text):
        text = unicodedata.normalize("NFKC", text).casefold()
        for a, b in zip("’‘“”", "''\"\""):
            text = text.replace(a, b)
        return " ".join(text.split())

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", graph.evidence(F.col("t")).alias("e")).collect()
    assert {r["t"]: r["e"] for r in rows} == {t: wanted(t) for t in texts}
    assert spark.createDataFrame([(None,)], "t string").select(graph.evidence(F.col("t"))).first()[0] is None


def test_quotes_meet_in_their_evidence_form(spark):
    docs = spark.createDataFrame([(1, "Die Straße ist ﬁnster."), (2, "DIE  STRASSE IST FINSTER")], "doc_id long, text string")
    quotes = spark.createDataFrame([(7, "strasse ist finster")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in graph.quotes_in(docs, quotes).collect()) == [1, 2]


def test_responses_are_parsed_or_told_why_not(spark):
    rows = [(1, '{"items": [1]}'), (2, '```json\n{"items": []}\n```'), (3, "```\n[]```"), (4, "{"), (5, None), (6, ""), (7, '{"items": {}}'), (8, " {}"), (9, '{"items": null}'), (10, '{"items": [], "items": []}')]
    good, skipped = responses.good_and_skipped(responses.parsed(spark.createDataFrame(rows, "k long, response string")), "k")
    assert sorted(r["k"] for r in good.collect()) == [1, 2]
    assert {r["k"]: r["reason"] for r in skipped.collect()} == {3: "not an object", 4: "invalid JSON", 5: "invalid JSON", 6: "invalid JSON", 7: "no array", 8: "no array", 9: "no array", 10: "invalid JSON"}
    assert [(r["position"], r["item"].toPython()) for r in responses.items(good, "k").collect()] == [(1, 1)]


def test_items_after_a_limit_are_not_looked_at(spark):
    sound = '{"document_id": "%s", "passage_id": "p", "type": "definition", "statement": " s ", "quote": "%s", "modality": "asserted", "attribution": "author", "qualifiers": "", "key_terms": ["k "], "selection_basis": "unique_concept"}'
    told = [sound % ("d", "one"), sound % ("d", "ONE"), '"text"', sound % ("d", "two"), sound % ("d", "four"), sound % ("d", "three"), '{"document_id": "d"}', '{"document_id": 3}', sound % ("e", "one"), sound % ("e", "two")]
    items = responses.items(responses.parsed(spark.createDataFrame([(1, f'{{"items": [{", ".join(told)}]}}')], "k long, response string")), "k")
    passages = spark.createDataFrame([("d", "p", "a1", "one two three"), ("e", "p", "a2", "one two three"), ("e", "p", "a2", "one two three")], "document_id string, passage_id string, anchor string, text string")
    reasons = lambda **limits: [r["reason"] for r in responses.judge(items, passages, **limits).orderBy("position").collect()]
    late = [None, "repeated evidence", "not an object", None]
    assert reasons(per_document=2) == [*late, "document limit", "document limit", "document limit", "unknown document", None, None]
    assert reasons(per_document=9) == [*late, "quote not found", None, "unsupported claim type", "unknown document", None, None]
    assert reasons(per_document=2, total=3) == [*late, "document limit", "document limit", "document limit", "unknown document", None, "total limit"]
    made = responses.claims(responses.judge(items, passages)).orderBy("position").collect()
    assert made[0]["statement"] == "s" and made[0]["key_terms"] == ["k"] and made[0]["anchor"] == "a1" and made[0]["claim_id"].startswith("d#p#claim-")


def test_resuming(spark):
    kind = "document_id string, content string, settings map<string,string>"
    now = spark.createDataFrame([(d, "c", {"model": "m", "prompt": "v7"}) for d in "abcdef"], kind)
    old = spark.createDataFrame([("a", "c", {"model": "m", "prompt": "v7"}), ("b", "x", {"model": "m", "prompt": "v7"}), ("c", "c", {"model": "m", "prompt": "v6"}), ("d", "c", {"model": "n", "prompt": "v6"}), ("e", "c", {"model": "m"}), ("e", "c", None), ("g", "c", {})], kind)
    assert {r["document_id"]: r["state"] for r in responses.resumed(now, old, {"prompt": ("v6", "v5")}).collect()} == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "other settings", "e": "other settings", "f": "new", "g": "gone"}
    assert {r["document_id"]: r["state"] for r in responses.resumed(now, old).collect()}["c"] == "other settings"


def test_titles_and_books(spark):
    pages = {
        "<!-- block a=title type=title -->EE7.2 – <b>One</b><!-- /block --><title>Two</title>": ("One", None),
        "<div id=x class='a discourse_title'></div><title>EE7 - </title><p class=title>Three &amp; four</p>": ("Three & four", None),
        "<h1>Head</h1> Published in: <a href='x'> </a> Published in <a>Book &amp; <i>co</i></a></div><a>no</a>": ("Head", "Book & co"),
        "Published in </div><a>no</a>": (None, None),
        "Published in <!-- /References --> <a>no</a> Published\nin <A HREF=y>yes</A>": (None, "yes"),
        "<div class='discourse_references'><a>Early</a> Published in</div>": (None, "Early"),
        "": (None, None),
    }
    rows = spark.createDataFrame([(p,) for p in pages], "p string").select("p", T.html_title(F.col("p")), T.html_book(F.col("p"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == pages
