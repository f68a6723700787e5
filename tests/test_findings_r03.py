"""What the findings of round 3 asked for."""

import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import alike, glossary


def test_references_without_a_semicolon_stay_where_only_closed_ones_count(spark):
    """As the SQL twins of html_title, html_text and html_front_matter have it; by default they are decoded, as browsers do."""
    page = "<title>a &amp; b&amp</title><p>&quot;c&quot; &#38; &amp;lt; &nosuch; &am"
    row = spark.createDataFrame([(page, "Published in <a>x &amp; y&amp</a>")], "p string, b string").select(
        T.html_title(F.col("p"), closed=True).alias("title"), T.html_title(F.col("p")).alias("open"), T.html_to_text(F.col("p"), closed=True).alias("text"), T.html_book(F.col("b"), closed=True).alias("book")
    ).first()
    assert row["title"] == "a & b&amp" and row["open"] == "a & b&" and row["book"] == "x & y&amp"
    assert row["text"] == 'a & b&amp "c" & &lt; &nosuch; &am'


def test_rare_characters_are_looked_up_not_tried_range_by_range(spark):
    """Nearly every query brings whole texts into one of these forms."""
    rows = spark.range(8, numPartitions=4).select(F.concat(F.repeat(F.lit("für die Größe été "), 60_000), "id").alias("t"))
    for form in (T.normalize, T.compatible):
        plan = rows.select(form(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert [c for c in ("ŉ", "x{a0}", "ŉ") if f"RLIKE [{c}" in plan] == [] and plan.count("RLIKE") <= 1  # Hangul's one range
    found = rows.select(T.normalize(F.col("t")).alias("n"), T.compatible(F.col("t")).alias("c")).first()
    assert found["n"].startswith("fur die grosse ete ") and found["c"].startswith("für die grösse été ")
    rare = spark.createDataFrame([("Straße ŉ ﬃ İ 각  é",)], "t string").select(T.normalize(F.col("t")).alias("n"), T.compatible(F.col("t")).alias("c")).first()
    assert rare["n"] == T.plain("Straße ŉ ﬃ İ 각  é") and rare["c"] == "strasse ʼn ffi i̇ 각  é"


def test_neighbours_are_made_once_for_each_block(spark):
    """Twenty thousand lines of one text: before, each line had all lines trimmed again."""
    lines = "\n".join(x for k in range(10_000) for x in (f" line {k} ", f"line  {k}", ""))
    rows = spark.createDataFrame([(lines,)], "t string").select(T.distinct_neighbours(F.split("t", "\n")).alias("b"))
    start = time.time()
    got = rows.first()["b"]
    assert time.time() - start < 60
    assert len(got) == 10_000 and got[:2] == ["line 0", "line 1"]


def test_batches_come_in_slices():
    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    parts = list(alike.in_slices(iter([batch])))
    assert max(p.num_rows for p in parts) <= 256 and [x for p in parts for x in p.column("x").to_pylist()] == list(range(1000))


def test_spellings_are_not_gathered_of_every_document(spark):
    docs = spark.createDataFrame([(1, "Zorg zorg the"), (1, "ZORG"), (2, "zorg THE 12 ab"), (None, "zorg")], "doc_id long, text string")
    found = glossary.candidates(docs, spark.createDataFrame([("the",)], "word string"))
    assert [tuple(r) for r in found.collect()] == [("zorg", 5, 2, ["ZORG", "Zorg", "zorg"], found.first()["priority"])]
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_index_rows_are_blocks_and_passages_alone_under_their_anchor_are_not_shuffled_for_equal_texts(spark, tmp_path):
    """F8: a row for each term and passage, and two shuffles of all texts, made search_index several times slower."""
    from lexmill.corpus import Corpus
    from lexmill.operators import postings, search

    rows = [("a", f"f{k % 7}.md", f"the title {k}", "the book", f"p{k}", k, f"the ferry of {k} the ferry") for k in range(40)] + [("b", None, "", None, None, 0, "ferry"), ("b", None, "", None, None, 1, "FERRY"), ("b", None, "", None, None, 2, "boat")]
    table = spark.createDataFrame(rows, "source string, relative_path string, title string, book string, anchor string, ordinal int, text string")
    assert search.first_of_equal(table.where("source = 'a'"))._jdf.queryExecution().optimizedPlan().toString().count("Window") == 0
    assert sorted(r["text"] for r in search.first_of_equal(table).where("source = 'b'").collect()) == ["boat", "ferry"]
    corpus = Corpus(spark, str(tmp_path / "c"))
    corpus.store(table)
    assert not (tmp_path / "c" / corpus._current() / "dealt").exists()
    assert corpus.postings().where("term = 'ferry' and source = 'a'").count() < 40
    found = {r["id"]: r for r in postings.of_term(corpus.postings(), "the").collect()}
    for p in corpus.passages().where("source = 'a'").collect():
        assert [found[p["id"]][f"{f}_at"] for f in search.FIELDS] == [[k for k, w in enumerate(p[f].split()) if w == "the"] for f in search.FIELDS]
        assert [found[p["id"]][f"{f}_n"] for f in search.FIELDS] == [1, 1, 2]
    parts = corpus.search('"the ferry" "ferry of"', "all", limit=50, context=None).collect()
    assert parts == search.search(corpus.passages(), '"the ferry" "ferry of"', "all", limit=50, context=None).orderBy("rank").collect() and len(parts) == 40


def test_blocks_of_parts_of_any_size(spark, monkeypatch):
    """F8: however few passages make blocks together, the index is the same."""
    from lexmill.operators import postings

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7, 8], pa.int64()), pa.array(["a", None, "a", "b"]), pa.array([" t ", "  ", "  ", " "]), pa.array(["  ", "  ", " x t ", "  "]), pa.array([" t  u t ", " u ", "  u t ", "  "])], names=["id", "source", "title", "book", "text"])

    def told(block):
        out = {}
        for b in block:
            for r in b.to_pylist():
                for k, id_ in enumerate(r["ids"]):
                    cut = lambda f: r[f"{f}_at"][(r[f"{f}_end"][k - 1] if k else 0) : r[f"{f}_end"][k]] if r[f"{f}_end"] else []  # noqa: B023, E731
                    out[r["term"], r["source"], id_] = cut("title"), cut("book"), cut("text")
                assert r["document_frequency"] == len(r["ids"]) and r["term_frequency"] == sum(len(r[f"{f}_at"]) for f in ("title", "book", "text"))
        return out

    want = {("t", "a", 5): ([0], [], [0, 2]), ("u", "a", 5): ([], [], [1]), ("u", None, 6): ([], [], [0]), ("x", "a", 7): ([], [0], []), ("t", "a", 7): ([], [1], [1]), ("u", "a", 7): ([], [], [0])}
    for size in (1, 12, 8_000_000):
        monkeypatch.setattr(postings, "AT_ONCE", size)
        assert told(postings._listed(iter([batch]))) == want
    assert told(postings._listed(iter([batch.slice(3)]))) == {}


def test_paragraphs_are_made_in_their_page_s_row(spark):
    """title and book were looked for again in the whole page for each of its paragraphs, and all paragraphs were shuffled by path to be numbered."""
    from lexmill.sources import files

    words = "a paragraph that is long enough to be kept"
    page = lambda n, title: f"<title>{title} &amp; x</title><body>" + "".join(f"<p>{words} {k} &lt;b&gt;</p><p>short</p>" for k in range(n)) + "</body>"
    rows = spark.createDataFrame([("u", "1", page(3, "one")), ("u", "2", page(2, "two")), (None, "3", page(1, "three")), (None, "4", None), ("v", "5", "<p>no</p>")], "path string, relative_path string, text string")
    found = files.html_paragraphs(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Generate ")[0]
    assert "Window" not in plan and "title" in plan and "regexp_extract(" not in above and "<title" not in above
    got = sorted((r["relative_path"], r["ordinal"], r["anchor"], r["title"], r["book"], r["text"]) for r in found.collect())
    assert got == [(p, k, f"p{2 * k + 1:04}", f"{t} & x", "", f"{words} {k} <b>") for p, t, n in (("1", "one", 3), ("2", "two", 2), ("3", "three", 1)) for k in range(n)]
