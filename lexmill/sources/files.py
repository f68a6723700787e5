"""Reading corpora from files: HTML pages, Markdown, word lists, EPUB, DOCX and XLSX, all by way of Spark's readers."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import text as T

#: Shorter paragraphs are no passages.
LEAST_CHARS = 30
#: Parts and characters of a chunk.
PARTS, CHUNK = 4, 2400


def files(spark: SparkSession, root: str, *patterns: str) -> DataFrame:
    """``path``, ``relative_path`` and ``content`` of all files below ``root`` that fit a pattern."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(patterns) + "}").load(root)
    base = root.rstrip("/").removeprefix("file://") + "/"
    return found.select("path", F.substring_index("path", base, -1).alias("relative_path"), "content")


def texts(spark: SparkSession, root: str, *patterns: str) -> DataFrame:
    return files(spark, root, *patterns).select("path", "relative_path", F.decode("content", "UTF-8").alias("text"))


def html_paragraphs(pages: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """One row for each ``<p>`` (or list item) of a page with ``least`` characters: title, book, anchor, ordinal, text. The ordinal counts kept ones.

    A page's title, book and paragraphs are made in its own row, once; no more than these go into the rows of its paragraphs, and nothing is shuffled.
    """
    found = F.regexp_extract_all("text", F.lit(r"(?is)<(?:p|li|blockquote)\b[^>]*>(.*?)(?=</?(?:p|li|blockquote|div|article|section|body)\b)"), F.lit(1))
    each = pages.select("path", "relative_path", T.html_title(F.col("text")).alias("title"), F.coalesce(T.html_book(F.col("text")), F.lit("")).alias("book"), F.transform(found, T.html_bare).alias("parts"))
    parts = F.transform(T.unescape_each(F.col("parts")), lambda part, k: F.struct(k.alias("k"), T.collapse(part).alias("text")))
    kept = each.select("path", "relative_path", "title", "book", F.posexplode(F.filter(parts, lambda x: F.length(x["text"]) >= least)).alias("ordinal", "part"))
    return kept.select("path", "relative_path", "title", "book", F.concat(F.lit("p"), F.lpad((F.col("part.k") + 1).cast("string"), 4, "0")).alias("anchor"), "ordinal", F.col("part.text").alias("text"))


def markdown_passages(docs: DataFrame) -> DataFrame:
    """Passages of Markdown texts (``relative_path``, ``text``): title, anchor ``section-S/chunk-C``, ordinal, text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, title, *row) for path, text in zip(batch["relative_path"], batch["text"], strict=True) for title, found in [read_markdown(text or "", path)] for row in found]
            yield pd.DataFrame(rows, columns=["relative_path", "title", "anchor", "ordinal", "text"])

    return docs.select("relative_path", "text").mapInPandas(cut, "relative_path string, title string, anchor string, ordinal int, text string")


_FURNITURE = re.compile(r"\s*(?:<!--.*-->|#{1,6}\s*(?:pdf )?page \d+|\[?page \d+\]?|-{3,}|\*{3,})\s*", re.I)
_HEADING = re.compile(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*")
_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+\S")


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """The keys of a leading ``---`` block and the text after it."""
    m = re.match(r"\ufeff?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", text, re.S)
    if not m:
        return {}, text
    pairs = (line.partition(":") for line in m[1].splitlines() if ":" in line)
    return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}, text[m.end() :]


def inline_text(text: str) -> str:
    """A block without Markdown marks."""
    for pattern, image in ((r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"`([^`]*)`", r"\1"), (r"<[^>]+>", ""), (r"(\*\*|__)(.+?)\1", r"\2"), (r"(?<![\w*])[*_](?=\S)([^*_\n]+?)[*_](?![\w*])", r"\1")):
        text = re.sub(pattern, image, text, flags=re.S)
    return html.unescape(text)


def blocks(body: str) -> Iterator[tuple[str, int, str]]:
    """(kind, level, text) of each block: heading, list, quote, code or paragraph. Page furniture is left out."""
    kind, held, fence = "", [], ""

    def close() -> Iterator[tuple[str, int, str]]:
        nonlocal kind
        if held:
            joined = "\n".join(held)
            if kind == "list":
                joined = re.sub(r"(?m)^(\s*)[+*](?=\s)", r"\1-", joined)
            yield kind, 0, joined if kind == "code" else inline_text(joined if kind in ("list", "quote") else " ".join(x.strip() for x in held))
        held.clear()
        kind = ""

    lines = body.replace("\r\n", "\n").split("\n")
    for n, line in enumerate(lines):
        if fence:
            if line.strip().startswith(fence):
                fence = ""
                yield from close()
            else:
                held.append(line)
            continue
        if _FURNITURE.fullmatch(line) and not (held and kind == "paragraph" and re.fullmatch(r"\s*-{3,}\s*", line)):
            yield from close()
        elif line.strip()[:3] in ("```", "~~~"):
            yield from close()
            fence, kind = line.strip()[:3], "code"
        elif m := _HEADING.fullmatch(line):
            yield from close()
            yield "heading", len(m[1]), inline_text(m[2])
        elif held and kind == "paragraph" and re.fullmatch(r"\s*(?:=+|-+)\s*", line):
            title = held.pop()
            yield from close()
            yield "heading", 2, inline_text(title.strip())
        elif not line.strip():
            yield from close()
        else:
            now = "quote" if line.lstrip().startswith(">") else "list" if _ITEM.match(line) or (kind == "list" and line[:1] in " \t") else "paragraph"
            if now != kind:
                yield from close()
                kind = now
            held.append(line.rstrip())
    yield from close()


def split_part(kind: str, text: str, most: int) -> list[str]:
    """A part that is too long, by lines (lists, quotes), then sentences, then words."""
    if len(text) <= most:
        return [text]
    for pieces, gap in ((text.split("\n") if kind in ("list", "quote", "code") else [], "\n"), (re.split(r"(?<=[.!?])\s+", text), " "), (text.split(), " ")):
        if len(pieces) > 1:
            packed: list[str] = []
            for piece in (p for x in pieces for p in (split_part("", x, most) if len(x) > most else [x])):
                if packed and len(packed[-1]) + len(gap) + len(piece) <= most:
                    packed[-1] += gap + piece
                else:
                    packed.append(piece)
            return packed
    return [text]


def read_markdown(text: str, path: str) -> tuple[str, list[tuple[str, int, str]]]:
    """The title, and (anchor, ordinal, text) of each chunk: a section's heading and up to four parts of 2400 characters."""
    keys, body = front_matter(text)
    title = keys.get("title") or re.sub(r"[-_]+", " ", path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
    sections: list[tuple[str, list[tuple[str, str]]]] = []
    for n, (kind, level, part) in enumerate(blocks(body)):
        if kind == "heading":
            if n == 0 and level == 1 and T.plain(part) == T.plain(title):
                continue
            sections.append((part, []))
        else:
            if not sections:
                sections.append(("", []))
            sections[-1][1].append((kind, part))
    rows: list[tuple[str, int, str]] = []
    for s, (heading, parts) in enumerate(sections, 1):
        room = CHUNK - (len(heading) + 2 if heading else 0)
        chunks: list[list[str]] = []
        for piece in (p for kind, part in parts for p in split_part(kind, part, room)):
            if chunks and len(chunks[-1]) < PARTS and sum(map(len, chunks[-1])) + 2 * len(chunks[-1]) + len(piece) <= room:
                chunks[-1].append(piece)
            else:
                chunks.append([piece])
        for c, chunk in enumerate(chunks or [[]], 1):
            rows.append((f"section-{s}/chunk-{c}", len(rows), "\n\n".join([heading, *chunk] if heading else chunk)))
    return title, rows


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Words of a list: the part of a line before a tab; comments, blanks and entries of several words are skipped."""
    word = T.normalize(F.trim(F.split(F.col("value"), "\t", 2)[0]))
    return spark.read.text(path).where(~F.trim("value").startswith("#")).select(word.alias("word")).where((F.col("word") != "") & ~F.col("word").rlike(r"\s")).distinct()


def ranked_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of a frequency table: its column ``word``, else ``lemma``, else the first field that is no number."""
    fields = F.split(F.trim("value"), "[\t,;]|\\s{2,}", -1)
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.transform(fields, F.trim).alias("f"))
    head = [x.lower() for x in (rows.first() or [[]])[0]]
    at = next((head.index(n) for n in ("word", "lemma") if n in head), None)
    named = F.get("f", F.lit(at)) if at is not None else F.get(F.filter("f", lambda x: x.rlike(r"\p{L}")), F.lit(0))
    return rows.select(T.normalize(named).alias("word")).where(F.col("word").isNotNull() & F.col("word").rlike(r"\p{L}") & ~F.col("word").isin("word", "lemma")).distinct()


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a glossary file: an object whose ``candidates`` are the rows."""
    kind = "candidates array<struct<normalized_form: string, canonical_surface_form: string, variants: array<string>, reason_codes: array<string>, evidence_contexts: array<struct<document: string, title: string, context: string>>, document_count: long, frequency: long, surface_frequency: map<string, long>>>"
    return spark.read.schema(kind).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("candidates"))


CLAIM = "claim_id string, document_id string, passage_id string, citation string, type string, statement string, quote string, key_terms array<string>, modality string, attribution string"
CONNECTION = "connection_id string, type string, confidence string, summary string, explanation string, claim_ids array<string>"
THEME = "theme_id string, label string, summary string, claim_ids array<string>"


def graph_artifact(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Claims, connections and themes of a graph's folder, or none if it has no claims; rows without id go, of repeated ids one stays.

    ``claims.json`` holds ``items`` or else ``claims``; ``relationships/result.json`` holds ``connections`` (or else
    ``relationships``) and ``themes``, and may be missing: then both are empty.
    """
    kind = lambda **fields: ", ".join(f"{k} array<struct<{v}>>" for k, v in fields.items())
    read = lambda schema, path: spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    whole = lambda rows, name: rows.select(F.inline(name)).where(F.coalesce(F.trim(f"{name}_id"), F.lit("")) != "")
    try:
        claims = read(kind(items=CLAIM, claims=CLAIM), f"{root}/claims.json").select(F.coalesce("items", "claims").alias("claim"))
    except AnalysisException:
        return None
    try:
        linked = read(kind(connections=CONNECTION, relationships=CONNECTION, themes=THEME), f"{root}/relationships/result.json")
    except AnalysisException:
        linked = spark.createDataFrame([], kind(connections=CONNECTION, relationships=CONNECTION, themes=THEME))
    linked = linked.select(F.coalesce("connections", "relationships").alias("connection"), F.col("themes").alias("theme"))
    tables = whole(claims, "claim"), whole(linked, "connection"), whole(linked, "theme")
    return tuple(rows.dropDuplicates([f"{name}_id"]) for rows, name in zip(tables, ("claim", "connection", "theme"), strict=True))


def _unpacked(read: Callable[[bytes], list[tuple[int, str]]], found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["relative_path"], batch["content"], strict=True):
                yield pd.DataFrame([(path, n, t) for n, t in read(content)], columns=["relative_path", "part", "text"])

    return found.select("relative_path", "content").mapInPandas(run, "relative_path string, part int, text string")


def epub(spark: SparkSession, root: str) -> DataFrame:
    """The (X)HTML members of EPUB books in reading order."""

    def read(content: bytes) -> list[tuple[int, str]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            opf = next(x.get("full-path") for x in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if x.tag.endswith("rootfile"))
            tree, base = ElementTree.fromstring(z.read(opf)), opf.rpartition("/")[0]
            items = {x.get("id"): x for x in tree.iter() if x.tag.endswith("}item")}
            spine = [items[x.get("idref")] for x in tree.iter() if x.tag.endswith("}itemref") and x.get("idref") in items]
            names = [f"{base}/{x.get('href')}".lstrip("/") for x in spine if "html" in (x.get("media-type") or "")]
            return [(n, z.read(name).decode("utf-8", "replace")) for n, name in enumerate(names)]

    return _unpacked(read, files(spark, root, "*.epub"))


def docx(spark: SparkSession, root: str) -> DataFrame:
    """The paragraphs of DOCX files as Markdown: headings by style, bold and italic runs marked."""

    def read(content: bytes) -> list[tuple[int, str]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            tree = ElementTree.fromstring(z.read("word/document.xml"))
        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        rows = []
        for p in tree.iter(f"{w}p"):
            out = ""
            for r in p.iter(f"{w}r"):
                said = "".join(t.text or "" for t in r.iter(f"{w}t"))
                marks = {x.tag.removeprefix(w) for x in r.findall(f"{w}rPr/*")}
                edge = "**" * ("b" in marks) + "*" * ("i" in marks)
                out += f"{edge}{said}{edge[::-1]}" if said.strip() else said
            style = p.find(f"{w}pPr/{w}pStyle")
            level = re.fullmatch(r"[Hh]eading ?(\d)", style.get(f"{w}val") or "") if style is not None else None
            if out.strip():
                rows.append((len(rows), "#" * int(level[1]) + " " + out.strip("* ") if level else out))
        return rows

    return _unpacked(read, files(spark, root, "*.docx"))


def xlsx(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all sheets of XLSX files, cells joined by tabs."""

    def read(content: bytes) -> list[tuple[int, str]]:
        space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")]
            rows: list[tuple[int, str]] = []
            for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
                for row in ElementTree.fromstring(z.read(name)).iter(f"{space}row"):
                    cells = []
                    for c in row.iter(f"{space}c"):
                        value = c.findtext(f"{space}v") or ""
                        cells.append(shared[int(value)] if c.get("t") == "s" else "".join(t.text or "" for t in c.iter(f"{space}t")) if c.get("t") == "inlineStr" else value)
                    rows.append((len(rows), "\t".join(cells)))
        return rows

    return _unpacked(read, files(spark, root, "*.xlsx"))


def with_front_matter(title: Column, body: Column, **keys: Column) -> Column:
    """A Markdown file's text with YAML front matter."""
    lines = [F.concat(F.lit("title: \""), F.replace(title, F.lit("\""), F.lit("\\\"")), F.lit("\""))]
    lines += [F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in keys.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), body)
