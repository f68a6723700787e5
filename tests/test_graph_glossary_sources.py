import io
import zipfile

from pyspark.sql import functions as F

from lexmill.operators import glossary, graph, search
from lexmill.sources import files
from lexmill.streaming import ingest


def test_claims(spark):
    places = spark.createDataFrame([("d1", "p0001", "The “quoted”  words are here."), ("d2", "p0001", "Other text.")], "document_id string, passage_id string, text string")
    items = [(0, "d1", "p0001", "s", '"Quoted" words'), (1, "d1", "p0001", "s", '"quoted"   WORDS'), (2, "d1", "p0001", "s", "are here"), (3, "d1", "p0009", "s", "x"), (4, "d2", "p0001", "s", "absent"), (5, "d2", "p0001", "", "other"), (6, "d1", "p0001", "s", "the"), (7, "d2", "p0001", "s", "text")]
    rows = spark.createDataFrame(items, "position int, document_id string, passage_id string, statement string, quote string")
    got = {r["position"]: r["reason"] for r in graph.validate(rows, places, per_document=2, total=2).collect()}
    assert got == {0: None, 1: "repeated evidence", 2: None, 3: "unknown passage", 4: "quote not in passage", 5: "no statement", 6: "too many of the document", 7: "too many in all"}


def test_connections(spark):
    claims = spark.createDataFrame([("a#1", "en", "alpha beta", "q"), ("b#1", "de", "beta", "q"), ("a#2", "en", "x", "q")], "claim_id string, source string, statement string, quote string")
    rows = [(0, "supports", "high", "s", "e", ["a#1", "b#1", "a#1"]), (1, "supports", "high", "again", "e", ["b#1", "a#1"]), (2, "supports", "high", "one", "e", ["a#1", "a#2"]), (3, "odd", "high", "s", "e", ["a#1", "b#1"]), (4, "extends", "high", "s", "e", ["a#1", "zz"])]
    rows += [(5, "extends", "low", "s", "e", ["a#1", "b#1"]), (6, "extends", "high", "s", None, ["a#1", "b#1"]), (7, "extends", "high", " ", "e", ["a#1", "b#1"]), (8, "extends", "high", "s", "e", ["a#1"]), (9, "extends", "high", "s", "e", None), (10, "extends", "high", "s", "e", ["a#1", "a#1"])]
    frame = spark.createDataFrame(rows, "position int, type string, confidence string, summary string, explanation string, claim_ids array<string>")
    told = {r["position"]: r["reason"] for r in graph.judge_connections(frame, claims, 5).collect()}
    assert told == {0: None, 1: "repeats an earlier one", 2: "within one document", 3: "unsupported type", 4: "unknown claim", 5: "unsupported confidence", 6: "no explanation", 7: "no summary", 8: "fewer than two claims", 9: "fewer than two claims", 10: "only one unique claim"}
    good = graph.validate_connections(frame, claims)
    assert [(r["connection_id"], r["position"], r["claim_ids"]) for r in good.collect()] == [("conn-001", 0, ["a#1", "b#1"])]
    assert graph.connections_of(good, claims, "beta").first()["score"] == 2
    assert graph.connections_of(good, claims, where="en").count() == 0


def test_themes_and_compaction(spark):
    claims = spark.createDataFrame([("a#1", "en", "alpha beta", "q", ["Term"]), ("b#1", "de", "beta", "q" * 2000, None)], "claim_id string, source string, statement string, quote string, key_terms array<string>")
    themes = spark.createDataFrame([("t1", "Label", "", ["a#1", "b#1"]), ("t2", "Label", "beta", ["a#1", "zz"]), ("t3", "Other", "s", ["b#1"]), ("t4", "", "", [])], "theme_id string, label string, summary string, claim_ids array<string>")
    assert [(r["theme_id"], r["score"]) for r in graph.themes_of(themes, claims, "beta").collect()] == [("t1", 2), ("t3", 1)]
    assert [r["theme_id"] for r in graph.themes_of(themes, claims, "term").collect()] == ["t1"]
    assert [r["theme_id"] for r in graph.themes_of(themes, claims, claim="b#1", where=("de",)).collect()] == ["t3"]
    links = spark.createDataFrame([("c1", "supports", "high", "about beta", "since", ["a#1", "b#1"])], "connection_id string, type string, confidence string, summary string, explanation string, claim_ids array<string>")
    assert graph.connections_of(links, claims, "since").count() == 1
    rows = graph.compact(graph.connections_of(links, claims, "beta"), graph.themes_of(themes, claims, "beta")).collect()
    assert [(r["graph_id"], r["kind"], r["summary"]) for r in rows] == [("c1", "connection", "about beta"), ("t1", "theme", "Label"), ("t3", "theme", "s")]
    assert [len(c["quote"]) for c in rows[0]["claims"]] == [1, 1200]
    places = spark.createDataFrame([(1, "en", "f", "s-1", 0, "t", "x")], "id long, source string, relative_path string, anchor string, ordinal int, title string, text string")
    cited = graph.cited(spark.createDataFrame([("a#1", "x:d", "p1", "en:f#s-1"), ("b#1", "de:d", "p1", "g")], "claim_id string, document_id string, passage_id string, citation string"))
    assert [tuple(r) for r in cited.orderBy("claim_id").select("source", "path", "anchor").collect()] == [("en", "f", "s-1"), ("de", "g", "")]
    assert graph.graph_stats(cited, links, themes, places).first().asDict() == {"claims": 2, "with_passage": 1, "connections": 1, "themes": 4, "claims_in_graph": 3, "unknown_claims": 1}


def test_ordinals_and_neighbours(spark):
    rows = spark.createDataFrame([(1, "a"), (4096, "a"), (4097, "a"), (9000, "a"), (9000, "a"), (5, None), (7, None)], "id long, book string")
    got = search.ordinals(rows, "book", "id")
    assert sorted((r["id"], r["ordinal"]) for r in got.where("book = 'a'").collect()) == [(1, 0), (4096, 1), (4097, 2), (9000, 3), (9000, 3)]
    assert sorted((r["id"], r["ordinal"]) for r in got.where("book is null").collect()) == [(5, 0), (7, 1)]
    near = search.neighbours(got.withColumnRenamed("book", "relative_path").withColumn("source", F.lit("s")), 1)
    assert {(r["id"], tuple(r["near"])) for r in near.collect()} == {(1, (1, 4096)), (4096, (1, 4096, 4097)), (4097, (4096, 4097, 9000, 9000)), (9000, (4097, 9000, 9000)), (5, (5, 7)), (7, (5, 7))}


def test_linking(spark):
    places = spark.createDataFrame([(1, "en", "f", "s-1", 0, "t", "x"), (2, "en", "f", "s-2", 1, "t", "y")], "id long, source string, relative_path string, anchor string, ordinal int, title string, text string")
    claims = spark.createDataFrame([("c1", "en", "f", "s-2", "p0001"), ("c2", "en", "f", "gone", "p0002"), ("c3", "en", "f", "gone", "zz")], "claim_id string, source string, path string, anchor string, passage_id string")
    assert {r["claim_id"]: r["passage"] and r["passage"]["id"] for r in graph.link_sources(claims, places).collect()} == {"c1": 2, "c2": 2, "c3": None}


def test_glossary(spark):
    docs = spark.createDataFrame([(1, 'the kīrtana singing and "Kīrtana" means song'), (2, "kirtana mantra walks"), (3, None)], "doc_id long, text string")
    words = spark.createDataFrame([(w,) for w in "the sing and mean song walk".split()], "word string")
    got = {r["term"]: (r["frequency"], r["documents"], r["priority"]) for r in glossary.candidates(docs, words).collect()}
    assert got == {"kirtana": (3, 2, 5), "mantra": (1, 1, 4)}
    assert [(r["run"], r["tokens"]) for r in glossary.runs(docs, words).collect()] == [("kirtana mantra", 2)]
    assert [(r["term"], r["defined"]) for r in glossary.quoted_terms(docs).collect()] == [("kirtana", True)]


def test_glossary_lookup(spark):
    kind = "normalized_form string, canonical_surface_form string, variants array<string>"
    rows = spark.createDataFrame([("delta river", "Delta River", ["Délta Rīver"]), ("river", "Rīver", []), ("the delta x river", "The", [])], kind)
    assert [r["normalized_form"] for r in glossary.lookup(rows, "délta  rīver").collect()] == ["delta river"]
    assert [r["normalized_form"] for r in glossary.search(rows, "delta river").collect()] == ["delta river", "the delta x river"]


MARKDOWN = """---
title: Book
---
# Book

Intro line
goes on.

## PDF page 2

- one
- two

> said

Part
----

""" + "\n\n".join(f"Paragraph {i}." for i in range(5))


def test_markdown(spark, tmp_path):
    (tmp_path / "x.md").write_text(MARKDOWN)
    (tmp_path / "p.html").write_text("<title>T &amp; U</title><body><p>short</p><p>A paragraph that is long <b>enough</b> to be kept &eacute;.</p></body>")
    got = files.markdown_passages(files.texts(spark, str(tmp_path), "*.md")).orderBy("ordinal").collect()
    assert [(r["title"], r["anchor"]) for r in got] == [("Book", "section-1/chunk-1"), ("Book", "section-2/chunk-1"), ("Book", "section-2/chunk-2")]
    assert got[0]["text"] == "Intro line goes on.\n\n- one\n- two\n\n> said"
    assert got[2]["text"] == "Part\n\nParagraph 4."
    page = files.html_paragraphs(files.texts(spark, str(tmp_path), "*.html")).first()
    assert (page["title"], page["anchor"], page["ordinal"], page["text"]) == ("T & U", "p0002", 0, "A paragraph that is long enough to be kept é.")


def test_packed_files(spark, tmp_path):
    def archive(name, members):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for k, v in members.items():
                z.writestr(k, v)
        (tmp_path / name).write_bytes(b.getvalue())

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    archive("a.docx", {"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t> text</w:t></w:r></w:p></w:body></w:document>'})
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    archive("a.xlsx", {"xl/sharedStrings.xml": f"<sst {s}><si><t>word</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>'})
    archive("a.epub", {"META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>', "o/c.opf": '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>', "o/a.xhtml": "A", "o/b.xhtml": "B"})
    root = str(tmp_path)
    assert [r["text"] for r in files.docx(spark, root).orderBy("part").collect()] == ["# Head", "**bold** text"]
    assert [r["text"] for r in files.xlsx(spark, root).collect()] == ["word\t7"]
    assert [r["text"] for r in files.epub(spark, root).orderBy("part").collect()] == ["B", "A"]


def test_word_lists(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# note\nÉtat\tx\ntwo words\n\nplain\n")
    (tmp_path / "c.tsv").write_text("rank\tlemma\tfreq\n1\tBe\t9\n2\tgo\t8\n")
    assert sorted(r["word"] for r in files.word_list(spark, str(tmp_path / "w.txt")).collect()) == ["etat", "plain"]
    assert sorted(r["word"] for r in files.ranked_words(spark, str(tmp_path / "c.tsv")).collect()) == ["be", "go"]


def test_stream(spark, tmp_path, data):
    spark.read.parquet(f"{data}/documents.parquet").write.parquet(str(tmp_path / "in"))
    ingest.store(ingest.stream_passages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
