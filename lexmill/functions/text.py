"""Column functions on text: normal form, words, white space, HTML and Markdown to text, names, quality."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a maximal run of letters and digits.
WORD = r"[\p{L}\p{N}]+"
#: Constant: blanks in the sense of Python's str.isspace, as a Java class.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def plain(text: str) -> str:
    """The normal form of a string: no combining marks, case-folded; the columns' reference."""
    kept = (c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return "".join(c.casefold() for c in kept)


@lru_cache(maxsize=1)
def character_map() -> tuple[str, str, dict[str, str]]:
    """Characters to translate, their images (deletions at the end have none), and those that become several.

    Hangul syllables are not among them: they follow a rule (``letters_of_hangul``).
    """
    single, gone, several = [], [], {}
    for code in (*range(0xD800), *range(0xE000, 0x110000)):
        if 0xAC00 <= code <= 0xD7A3:
            continue
        c = chr(code)
        image = plain(c)
        if image != c:
            if not image:
                gone.append(c)
            elif len(image) == 1:
                single.append((c, image))
            else:
                several[c] = image
    return "".join(a for a, _ in single) + "".join(gone), "".join(b for _, b in single), several


def letters_of_hangul(text: Column) -> Column:
    """Hangul syllables as their two or three letters, by arithmetic on their code points; everything else as it is."""
    jamo = lambda first, count: F.array(*(F.lit(chr(first + k)) for k in range(count)))

    def letters(c: Column) -> Column:
        n = F.ascii(c) - 0xAC00
        last = F.when(n % 28 > 0, F.get(jamo(0x11A7, 28), n % 28)).otherwise("")
        return F.when((n >= 0) & (n < 11172), F.concat(F.get(jamo(0x1100, 19), F.floor(n / 588).cast("int")), F.get(jamo(0x1161, 21), F.floor(n % 588 / 28).cast("int")), last)).otherwise(c)

    return F.when(text.rlike("[\uac00-\ud7a3]"), F.array_join(F.transform(F.split(text, ""), letters), "")).otherwise(text)


def has_any(text: Column, characters: str) -> Column:
    """Whether a text has one of many characters, each of them looked up once; a class of a regular expression would try its ranges one by one."""
    return F.length(F.translate(text, characters, "")) < F.length(text)


def expanded(text: Column, several: dict[str, str]) -> Column:
    """Characters replaced by strings; those beyond Latin-1 are looked for one by one only in texts that have any."""
    for c, image in several.items():
        if ord(c) < 0x100:
            text = F.replace(text, F.lit(c), F.lit(image))
    rare = {c: image for c, image in several.items() if ord(c) >= 0x100}
    chained = text
    for c, image in rare.items():
        chained = F.replace(chained, F.lit(c), F.lit(image))
    return F.when(has_any(text, "".join(rare)), chained).otherwise(text)


def normalize(text: Column) -> Column:
    """Case-folded text without combining marks, on built-in functions alone."""
    source, target, several = character_map()
    is_ascii = F.octet_length(text) == F.length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(F.translate(letters_of_hangul(expanded(text, several)), source, target))


@lru_cache(maxsize=1)
def folding() -> tuple[str, str, dict[str, str], str]:
    """What folding case does to single characters (as in ``character_map``), and the characters by which a text may be changed by NFKC.

    These are the ones that NFKC changes by themselves, those with a combining class, and those that come second in a composition.
    """
    single, several, unsure = [], {}, []
    second = {int(parts[1], 16) for code in range(0x110000) if (parts := unicodedata.decomposition(chr(code)).split()) and len(parts) == 2 and "<" not in parts[0]}
    for code in (*range(0xD800), *range(0xE000, 0x110000)):
        c = chr(code)
        if code in second or unicodedata.combining(c) or 0x1160 <= code <= 0x11FF or unicodedata.normalize("NFKC", c) != c:
            unsure.append(code)
        elif (image := c.casefold()) != c:
            if len(image) == 1:
                single.append((c, image))
            else:
                several[c] = image
    return "".join(a for a, _ in single), "".join(b for _, b in single), several, "".join(map(chr, unsure))


def compatible(text: Column) -> Column:
    """Text in NFKC with its case folded. Texts that NFKC can't change stay on built-in functions; the others go to Python in batches."""
    source, target, several, unsure = folding()
    is_ascii = F.octet_length(text) == F.length(text)
    asks = ~is_ascii & has_any(text, unsure)

    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")

    plainly = F.when(is_ascii, F.lower(text)).otherwise(F.translate(expanded(text, several), source, target))
    return F.coalesce(F.pandas_udf(fold, "string")(F.when(asks, text)), plainly)


def tokens(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(WORD), F.lit(0))


def spaced(normal: Column) -> Column:
    """The words of a normalised text with a blank before, between and after: phrases become substrings."""
    return F.concat(F.lit(" "), F.regexp_replace(normal, r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def occurrences(words: Column, phrase: list[str]) -> Column:
    """How often adjacent words occur in ``spaced`` text; occurrences may overlap."""
    return F.regexp_count(words, F.lit("(?= " + " ".join(phrase) + " )"))


def collapse(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"{BLANK}+", " "), "^ | $", "")


def closed_references(text: str) -> str:
    """A string with its character references decoded as far as a semicolon ends them."""
    return re.sub("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));", lambda m: html.entities.html5.get(f"{m[1]};", m[0]) if m[1] else html.unescape(m[0]), text)


def unescape(text: Column, closed: bool = False) -> Column:
    """Character references decoded; no built-in function does that. ``closed``: only those that a semicolon ends, else also ``&amp`` and its like."""

    def decode(values: pd.Series) -> pd.Series:
        return values.map(closed_references if closed else html.unescape, na_action="ignore")

    decoded = F.pandas_udf(decode, "string")(F.when(F.contains(text, F.lit("&")), text))  # texts without a reference stay outside Python
    return F.coalesce(decoded, text)


def unescape_each(texts: Column) -> Column:
    """``unescape`` for the strings of an array; arrays without a reference stay outside Python."""

    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda parts: [html.unescape(x) for x in parts], na_action="ignore")

    decoded = F.pandas_udf(decode, "array<string>")(F.when(F.exists(texts, lambda x: F.contains(x, F.lit("&"))), texts))
    return F.coalesce(decoded, texts)


BLOCK_TAGS = "address|article|blockquote|br|div|h[1-6]|hr|li|ol|p|pre|section|table|td|th|tr|ul"


def html_bare(page: Column) -> Column:
    """Block boundaries become blanks, other tags go."""
    return F.regexp_replace(F.regexp_replace(page, f"(?i)</?(?:{BLOCK_TAGS})\\b[^>]*>", " "), "(?s)<[^>]*>", "")


def html_to_text(page: Column, closed: bool = False) -> Column:
    """Block boundaries become blanks, other tags go, references are decoded (see ``unescape``), white space is collapsed."""
    return collapse(unescape(html_bare(page), closed))


# Where a page's title may stand, in order; what a number in front of it looks like; what announces its book and what ends the place where that stands.
TITLES = (
    r"(?is)<!--\s*block\s+a=title\s+type=title\s*-->(.*?)<!--\s*/block\s*-->",
    r"(?is)<div[^>]*class\s*=\s*[\"'][^\"']*\bdiscourse_title\b[^\"']*[\"'][^>]*>(.*?)</div>",
    r"(?is)<title[^>]*>(.*?)</title>",
    r"(?is)<(?:p|div|h1)[^>]*class\s*=\s*(?:[\"'][^\"']*\btitle\b[^\"']*[\"']|[^\s>]*\btitle\b[^\s>]*)[^>]*>(.*?)</(?:p|div|h1)>",
)
TITLE_NUMBER = r"^EE7[.\d]*\s*(?:-|–|&ndash;|&#8211;)\s*"
BOOK_MARK, BOOK_END, LINK = r"Published\s+in\s*:?", r"<!-- /References -->|(?i:</div>)|(?i:</body>)", r"(?is)<a\b[^>]*>(.*?)</a\s*>"
REFERENCES = r"(?is)<div[^>]*class\s*=\s*[\"'][^\"']*discourse_references[^\"']*[\"'][^>]*>(.*?)</div\s*>"


def _bare(fragment: Column) -> Column:
    """Markup as text, but for character references other than blanks."""
    spaced_ = F.regexp_replace(F.regexp_replace(fragment, f"(?i)</?(?:{BLOCK_TAGS})\\b[^>]*>|&nbsp;|&#160;", " "), "(?s)<[^>]*>", "")
    return collapse(spaced_)


def html_title(page: Column, closed: bool = False) -> Column:
    """The page's title: a title block, a title division, the title element or an element of class title, without a number in front; else its first heading; null if none has text."""
    parts = [F.regexp_replace(_bare(F.regexp_extract(page, p, 1)), TITLE_NUMBER, "") for p in (*TITLES, "(?is)<h1[^>]*>(.*?)</h1>")]
    return collapse(unescape(F.coalesce(*(F.nullif(p, F.lit("")) for p in parts)), closed))


def html_book(page: Column, closed: bool = False) -> Column:
    """The book of a page: the first link with text after a publication mark, up to the end of where these stand; else the first link of a division of references that has such a mark; null if none.

    What follows a mark reaches to the next one here: a link beyond that is the next mark's own.
    """
    texts = lambda parts: F.filter(F.transform(parts, lambda p: _bare(F.regexp_extract(p, LINK, 1))), lambda t: t != "")
    after = F.transform(F.slice(F.split(page, BOOK_MARK, -1), 2, 2**31 - 2), lambda p: F.get(F.split(p, BOOK_END, 2), F.lit(0)))
    listed = F.filter(F.regexp_extract_all(page, F.lit(REFERENCES), F.lit(1)), lambda p: p.rlike(BOOK_MARK))
    return collapse(unescape(F.coalesce(F.get(texts(after), F.lit(0)), F.get(texts(listed), F.lit(0))), closed))


def markdown_to_text(block: Column) -> Column:
    """Markdown marks go, their texts stay: fences, images, links, code, headings, tags, emphasis."""
    for pattern, image in (
        (r"(?m)^[ \t]*(?:```|~~~)[^\n]*$", ""),
        (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"`([^`]*)`", "$1"),
        (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", ""),
        (r"(?s)<[^>]+>", ""),
        (r"(\*\*|__)(.+?)\1", "$2"),
        (r"(?<![\w*])[*_](?=\S)([^*_\n]+?)[*_](?![\w*])", "$1"),
    ):
        block = F.regexp_replace(block, pattern, image)
    return collapse(unescape(block))


def slug(name: Column, fallback: str = "source") -> Column:
    """Lower-case ASCII words joined by hyphens."""
    ascii_ = F.regexp_replace(normalize(name), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(ascii_, "^-+|-+$", ""), F.lit("")), F.lit(fallback))


def readable(stem: Column) -> Column:
    """A file stem as a title: separators become blanks, first letters capitals, the rest stays as it is."""
    words = F.filter(F.split(F.regexp_replace(stem, r"[-_\s]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def natural_key(anchor: Column) -> Column:
    """Sorts anchors by text and number parts in turn: chunk-2 before chunk-10."""
    low = F.lower(anchor)
    numbers = F.transform(F.regexp_extract_all(low, F.lit("([0-9]+)"), 1), lambda x: x.cast("decimal(38,0)"))
    return F.transform(F.split(low, "[0-9]+", -1), lambda x, i: F.struct(x.alias("t"), F.get(numbers, i).alias("n")))


def strip_code_fence(text: Column) -> Column:
    """A response without carriage returns, NULs and one outer Markdown or JSON fence."""
    flat = F.translate(F.regexp_replace(text, "\r\n?", "\n"), "\x00", "")
    trimmed = F.regexp_replace(flat, f"^{BLANK}+|{BLANK}+$", "")
    return F.regexp_replace(trimmed, r"(?is)\A```(?:md|markdown|json)?[ \t]*\n(.*)\n[ \t]*```\z", "$1")


#: Fixed value: what a note about a page without text may say.
NON_TEXT = ("non-text", "non text", "illustration", "no readable text", "no text transcribed", "image or illustration")


def page_counts(text: Column) -> dict[str, Column]:
    """What is counted of a transcribed page; worth computing once (see ``page_quality``)."""
    lines = F.filter(F.transform(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1), lambda x: F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")), lambda x: x != "")
    # one pass over the sorted lines: the second of equal lines counts for two, each further one for itself
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("total"), F.lit(0).alias("lines"))

    def step(acc: Column, x: Column) -> Column:
        counts = F.length(x) >= 8
        same = counts & (x == acc["last"])
        grown = acc["total"] + F.when(same, F.when(acc["run"] == 1, 2).otherwise(1)).otherwise(0)
        return F.struct(F.when(counts, x).otherwise(acc["last"]).alias("last"), F.when(same, acc["run"] + 1).when(counts, 1).otherwise(acc["run"]).alias("run"), grown.alias("total"), (acc["lines"] + 1).alias("lines"))

    note = F.lit(False)
    for mark in NON_TEXT:
        note = note | F.contains(F.lower(text), F.lit(mark))
    return {
        "of_lines": F.aggregate(F.array_sort(lines), start, step, lambda acc: F.struct(acc["total"].alias("repeated"), acc["lines"].alias("count"))),
        "characters": F.length(text), "words": F.regexp_count(text, F.lit(r"(?<![\p{L}\p{N}_'-])(?=['-]*[\p{L}\p{N}_])[\p{L}\p{N}_'-]+")),
        "replaced": F.regexp_count(text, F.lit("�")), "control": F.regexp_count(text, F.lit(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]")), "note": note,
    }


def page_quality() -> dict[str, Column]:
    """Counts and warnings of a page from the columns of ``page_counts``."""
    count, words, replaced, control = F.col("of_lines.count"), F.col("words"), F.col("replaced"), F.col("control")
    ratio = F.when(count > 0, F.col("of_lines.repeated") / count).otherwise(F.lit(0.0))
    warnings = F.array_compact(
        F.array(
            F.when(replaced > 0, "replacement_characters"),
            F.when(control > 0, "control_characters"),
            F.when(F.col("characters") > 60_000, "unusually_long_page_output"),
            F.when((ratio >= 0.6) & (count >= 4), "repeated_lines"),
            F.when((words < 3) & ~F.col("note"), "very_short_output"),
        )
    )
    return {
        "status": F.when(F.size(warnings) > 0, "warning").otherwise("ok"), "warnings": warnings, "character_count": F.col("characters"), "word_count": words,
        "line_count": count, "replacement_character_count": replaced, "control_character_count": control, "repeated_line_ratio": F.bround(ratio, 4),
    }


def allowed_distance(term: Column) -> Column:
    """Edits a misspelt word may be away, by its length."""
    n = F.length(term)
    return F.when(n <= 5, 1).when(n <= 10, 2).when(n <= 16, 3).otherwise(4)


def rough_tokens(text: Column) -> Column:
    return F.bround(F.length(text) / 4, 0).cast("long")


#: What precedes a key in an error text.
KEY_PLACES = (r"(?i)(authorization\s*:\s*bearer\s+)[^\s,;]+", r"(?i)(access_token\s*[=:]\s*)[^\s,;&]+", r"(?i)(api[_-]?key\s*[=:]\s*)[^\s,;&]+", r"(?i)(x-goog-api-key\s*[=:]\s*)[^\s,;&]+")


def redact_keys(text: Column) -> Column:
    """Error texts without bearer tokens and keys."""
    for pattern in KEY_PLACES:
        text = F.regexp_replace(text, pattern, "$1<redacted>")
    return text


def unquoted(text: Column) -> Column:
    """A text on one line without the quotes around all of it."""
    flat = collapse(text)
    wrapped = flat.rlike("(?s)^([\"']).*\\1$") & (F.length(flat) >= 2)
    return F.when(wrapped, F.regexp_replace(F.substr(flat, F.lit(2), F.length(flat) - 2), "^ +| +$", "")).otherwise(flat)


def place_label(anchor: Column, numbered: Column) -> Column:
    """An anchor in words; ``numbered``: whether its source has numbered paragraphs instead of sections."""
    section, chunk = (F.regexp_extract(anchor, r"(?i)^section-(\d+)(?:/chunk-(\d+))?$", k) for k in (1, 2))
    return (
        F.when(~numbered & (section != ""), F.concat(F.lit("section "), section, F.when(chunk != "", F.concat(F.lit(", excerpt "), chunk)).otherwise("")))
        .when(anchor.rlike(r"^\d+$"), F.concat(F.lit("paragraph "), anchor))
        .otherwise(F.concat(F.lit("source location "), F.regexp_replace(anchor, "[-_]+", " ")))
    )


def without_controls(text: Column) -> Column:
    """Terminal output without escape sequences, carriage returns and other control characters."""
    for pattern in (r"(?s)\x1b\].*?(?:\x07|\x1b\\)", r"\x1b\[[0-?]*[ -/]*[@-~]", r"\x1b\([0-2]", r"(?s)\x1b[^\x20-\x7e]", r"\r", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"):
        text = F.regexp_replace(text, pattern, "")
    return text


def tail(text: Column, most: int = 200_000) -> Column:
    """The end of a long text, with a note that its beginning is left out."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.lit("[Earlier terminal output omitted]\n"), F.right(text, F.lit(most))))


def emphasis(text: Column) -> Column:
    """The bold and italic parts of a line: kind and text, in order; blank ones don't count."""
    pattern = r"\*\*([^*\n]+?)\*\*|\*([^*\n]+?)\*"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("bold"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("italic"))
    parts = F.transform(found, lambda p: F.struct(F.when(p["bold"] != "", "bold").otherwise("italic").alias("kind"), F.when(p["bold"] != "", p["bold"]).otherwise(p["italic"]).alias("text")))
    return F.filter(parts, lambda p: F.trim(p["text"]) != "")


def without_page_marks(text: Column) -> Column:
    """Page text without page comments and page headings; no blanks at line ends, one empty line at most."""
    text = F.regexp_replace(text, r"(?i)<!--\s*(?:pdf\s+)?page\s*:\s*\d+\s*-->", "")
    text = F.regexp_replace(text, r"(?im)^[ \t]*(?:#{1,6}[ \t]+)?(?:pdf[ \t]+)?page(?:[ \t]*:[ \t]*|[ \t]+)\d+[ \t]*#?[ \t]*(?:\n|\z)", "")
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+(?=\n|\\z)", "")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), f"^{BLANK}+|{BLANK}+$", "")


def words_in(text: Column) -> Column:
    """How many runs between white space a text has."""
    return F.size(F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")).cast("long")


def distinct_neighbours(blocks: Column) -> Column:
    """Blocks without blank ones and without those that repeat the block before them.

    The trimmed blocks are the only element of an array whose transformation names them, so that each is made once, not once for every other.
    """
    trimmed = F.filter(F.transform(blocks, lambda b: F.regexp_replace(b, f"^{BLANK}+|{BLANK}+$", "")), lambda b: b != "")
    pairs = F.transform(trimmed, lambda b: F.struct(b.alias("block"), collapse(b).alias("flat")))
    kept = F.flatten(F.transform(F.array(pairs), lambda rows: F.filter(rows, lambda p, i: (i == 0) | (p["flat"] != F.get(rows, i - 1)["flat"]))))
    return F.transform(kept, lambda p: p["block"])


def updated_at(*columns: str) -> Column:
    """The first time stamp that is there, else now, in milliseconds."""
    return F.coalesce(*(F.col(c).cast("long") for c in columns), F.unix_millis(F.current_timestamp()))


def python_words(text: str) -> list[str]:
    """The words of a query on the driver, as ``tokens`` gives them for columns."""
    return re.findall(r"[^\W_]+", plain(text))
