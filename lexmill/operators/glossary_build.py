"""Building a glossary: an English baseline in layers, events that speak for terms, and entries with evidence.

Words are told from English ones once for each distinct surface, in a join with the lexicon. What is not English goes back
to the passages that have it; there, marked spans and definitions are weighed, which needs a passage's words in order and at
their places. Everything after that is aggregation: no step gathers a term's occurrences, only its counts, its
spellings and its first few places.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import staged
from .alike import in_slices
from .glossary import DEFINES, TERM, WEIGHTS, derived_forms, excerpt, has_marks, lookup_forms

#: Reasons in alphabetical order; their places are the bits of a mask.
REASONS = tuple(sorted(WEIGHTS))
BIT = {reason: 1 << k for k, reason in enumerate(REASONS)}
# Zipf frequencies from which a word is common English, from which a word that it derives from is, and which the word itself must then have.
COMMON, DERIVED_FROM, DERIVED_SELF = 2.5, 2.0, 1.0
# Words that end a definition's subject on its left, and those that may stand between subject and cue.
STOPS = frozenset("a an and also as called definition defined form from in is its known meaning means name of one or practice refers term the this to word words".split())
BRIDGES = frozenset("are is was were".split())
# Letters around a cue that count as near, words of a span or subject at most, and words of a span that mixes known and unknown ones.
NEAR, SPAN, MIXED = 72, 8, 4
# What is stripped from the ends of surfaces and, with the apostrophe, of keys.
EDGE = " \t\r\n.,;:!?()[]{}\"“”‘’"
# Marked spans.
DOUBLE = r"[\"“]([^\"”\n]{1,240})[\"”]"
SINGLE = r"(?<![\p{L}\p{N}_])['‘]([^'’\n]{1,240})['’](?![\p{L}\p{N}_])"
ITALIC = r"(?is)<(?:i|em)\b[^>]*>(.*?)</(?:i|em)\s*>"


# --- English baseline ------------------------------------------------------------------------


def lexicon(lists: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """One row per word: whether a list has it (``lists``: ``word``, of any number of lists) and its Zipf frequency (``ranked``: ``word``, ``zipf``)."""
    rows = lists.select("word", F.lit(True).alias("listed"), F.lit(None).cast("double").alias("zipf"))
    if ranked is not None:
        rows = rows.unionByName(ranked.select("word", F.lit(False).alias("listed"), F.col("zipf").cast("double").alias("zipf")))
    return rows.where(F.col("word").isNotNull() & (F.col("word") != "")).groupBy("word").agg(F.max("listed").alias("listed"), F.max("zipf").alias("zipf"))


def zipf(counts: DataFrame, floor: float) -> DataFrame:
    """``word`` and ``zipf`` from ``word`` and ``n``: the logarithm of the occurrences in a thousand million words, two places.

    Words under ``floor`` are left out, so that there are at most 10 ** (9 - floor), whatever the size of the corpus.
    """
    total = counts.agg(F.sum("n").alias("total"))
    score = F.round(F.log10(F.col("n") * F.lit(1e9) / F.col("total")), 2)
    return counts.crossJoin(F.broadcast(total)).select("word", score.alias("zipf")).where(F.col("zipf") >= floor)


def term_key(surface: Column) -> Column:
    """The key of a surface: references decoded, straight apostrophes, no marks, case folded, nothing around it."""
    straight = F.translate(T.unescape(surface), "’‘", "''")
    edge = "[" + re.escape(EDGE + "'") + "]+"
    return F.regexp_replace(T.collapse(T.normalize(T.collapse(straight))), f"^{edge}|{edge}$", "")


def word_key(surface: Column) -> Column:
    """``term_key`` for single words, which hold no references and nothing to strip but apostrophes."""
    return T.normalize(F.translate(surface, "’", "'"))


def layers(surfaces: DataFrame, words: DataFrame, common: float = COMMON, derived_from: float = DERIVED_FROM, derived_self: float = DERIVED_SELF) -> DataFrame:
    """``surface``, ``term``, ``layer``, ``zipf``, ``candidate`` and ``special`` of distinct ``surface`` rows.

    ``layer`` tells what makes a word English: ``list`` (a list has one of its forms), ``frequency`` (a form is common),
    ``derivation`` (the word is known and derives from a common one; plain ASCII words only), ``possessive`` (what stands
    before 's is English); null: nothing. ``zipf`` is that of its most frequent form. A ``candidate`` is a word with a letter, two characters or more and no layer; ``special`` are
    also words with marks and those that are known but not common.
    """
    rows = surfaces.select("surface", word_key(F.col("surface")).alias("term"))
    plain = F.col("surface").rlike("^[A-Za-z]+$")
    owner = F.when(F.col("term").endswith("'s"), F.left("term", F.length("term") - 2))
    kinds = {"own": lookup_forms(F.col("term")), "origin": F.when(plain, derived_forms(F.col("term"))), "owner": lookup_forms(owner)}
    none = F.array().cast("array<string>")

    def probe(kind: str, forms: Column) -> Column:
        return F.transform(F.coalesce(forms, none), lambda f: F.struct(F.lit(kind).alias("kind"), f.alias("word")))

    probes = F.concat(*(probe(kind, forms) for kind, forms in kinds.items()))
    known = rows.select("surface", F.explode(probes).alias("p")).select("surface", "p.kind", "p.word").join(words, "word")
    best = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("zipf")))
    in_list = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("listed")))
    told = known.groupBy("surface").agg(in_list("own").alias("own_listed"), best("own").alias("zipf"), best("origin").alias("origin"), in_list("owner").alias("owner_listed"), best("owner").alias("owner"))
    layer = (
        F.when(F.col("own_listed"), "list")
        .when(F.col("zipf") >= common, "frequency")
        .when((F.col("zipf") >= derived_self) & (F.col("origin") >= derived_from), "derivation")
        .when(F.col("owner_listed") | (F.col("owner") >= common), "possessive")
    )
    rows = rows.join(told, "surface", "left").select("surface", "term", layer.alias("layer"), "zipf")
    candidate = F.col("layer").isNull() & (F.length("term") >= 2) & F.col("surface").rlike(r"\p{L}")
    rare = F.coalesce((F.col("zipf") > 0) & (F.col("zipf") < common), F.lit(False))
    return rows.withColumn("candidate", candidate).withColumn("special", candidate | has_marks(F.col("surface")) | rare)


# --- marked spans, definitions, events ---------------------------------------------------------


def marked(text: Column, raw: Column) -> Column:
    """Spans in double quotes, those of several words in single quotes, and the italic ones of the raw markup, in this order: reason and surface."""
    quoted = F.concat(F.regexp_extract_all(text, F.lit(DOUBLE), F.lit(1)), F.filter(F.regexp_extract_all(text, F.lit(SINGLE), F.lit(1)), lambda s: s.rlike(T.BLANK)))
    bare = F.transform(F.regexp_extract_all(raw, F.lit(ITALIC), F.lit(1)), lambda s: F.regexp_replace(F.regexp_replace(s, f"(?i)</?(?:{T.BLOCK_TAGS})\\b[^>]*>", " "), "(?s)<[^>]*>", ""))
    italic = F.filter(F.transform(F.split(T.unescape(F.array_join(bare, "\x01")), "\x01"), T.collapse), lambda s: s != "")
    told = lambda spans, reason: F.transform(F.coalesce(spans, F.array().cast("array<string>")), lambda s: F.struct(F.lit(reason).alias("reason"), s.alias("surface")))
    return F.concat(told(quoted, "quoted"), told(italic, "italic"))


class Word(NamedTuple):
    surface: str
    start: int
    end: int
    key: str


@lru_cache(maxsize=50_000)
def key_of(surface: str) -> str:
    """``term_key`` for strings."""
    straight = html.unescape(surface).replace("’", "'").replace("‘", "'")
    return " ".join(T.plain(" ".join(straight.split())).split()).strip(EDGE + "'")


def clean(surface: str) -> str:
    return " ".join(html.unescape(surface).split()).strip(EDGE)


class Passage:
    """A passage's words in order, and what speaks for terms in it."""

    def __init__(self, text: str, unknown: set[str], special: set[str]) -> None:
        import regex

        self.text, self.unknown, self.special = text, unknown, special
        self.find = regex.compile(TERM).finditer
        self.words = self.split(text)
        self.cues = [(m.start(), m.end()) for m in re.finditer(DEFINES, text, re.IGNORECASE)]

    def split(self, text: str) -> list[Word]:
        return [Word(m.group(), m.start(), m.end(), key_of(m.group())) for m in self.find(text)]

    @staticmethod
    def runs(text: str, words: list[Word], chosen: set[int]) -> Iterator[str]:
        """Two or more chosen words in a row with nothing but white space, slashes and hyphens between."""
        first = last = None
        for k in [*sorted(chosen), None]:
            joined = first is not None and k == last + 1 and re.fullmatch(r"[\s/-]+", text[words[last].end : words[k].start])
            if not joined:
                if first is not None and last > first:
                    yield text[words[first].start : words[last].end]
                first = k
            last = k

    def defined(self, span: str) -> bool:
        """Whether the span stands near a cue anywhere in the passage."""
        if not span or not self.cues:
            return False
        places = [(m.start(), m.end()) for m in re.finditer(re.escape(span), self.text, re.IGNORECASE)]
        return any(abs(a - end) <= NEAR or abs(start - b) <= NEAR for start, end in places for a, b in self.cues)

    def subject(self, cue: int) -> list[int]:
        """The words before a cue that it defines, by their numbers: back from it to a stop word, a full stop or colon, or too far."""
        found: list[int] = []
        k = len(self.words) - 1
        while k >= 0 and len(found) < SPAN:
            word = self.words[k]
            if word.end <= cue:
                barrier = found and re.search(r"[.!?;:]", self.text[word.end : self.words[found[0]].start])
                if cue - word.end > NEAR or barrier:
                    break
                if found or word.key not in BRIDGES:
                    if word.key in STOPS:
                        break
                    found.insert(0, k)
            k -= 1
        return found

    def span(self, reason: str, surface: str) -> Iterator[tuple[str, int, bool]]:
        """A marked span as one term, or else the special words and runs in it: surface, reasons, whole."""
        words = self.split(surface)
        special = {k for k, w in enumerate(words) if w.surface in self.special}
        defined = self.defined(surface)
        if not special:
            if not defined:
                return
            special = set(range(len(words)))
        short = reason == "italic" or len(words) == 2
        whole = len(words) <= SPAN and (len(special) == len(words) or defined or (short and any(w.surface in self.unknown for w in words)))
        if special and (whole or (short and 2 <= len(words) <= MIXED)):
            yield surface, BIT[reason], True
            return
        for k in sorted(special):
            yield words[k].surface, BIT[reason], False
        for run in self.runs(surface, words, special):
            yield run, BIT[reason] | BIT["multiword_non_english"], False

    def definitions(self) -> Iterator[tuple[str, str]]:
        """Subjects of several words, then single words near cues: those that are unknown or of a subject."""
        subjects = [self.subject(a) for a, _ in self.cues]
        for first, last in dict.fromkeys((s[0], s[-1]) for s in subjects if len(s) > 1):
            yield "subject", self.text[self.words[first].start : self.words[last].end]
        seen: set[int] = set()
        for (a, b), subject in zip(self.cues, subjects, strict=True):
            for k, word in enumerate(self.words):
                if word.key in STOPS or (word.surface not in self.unknown and k not in subject):
                    continue
                if max(a - word.end, word.start - b, 0) <= NEAR and k not in seen:
                    seen.add(k)
                    yield "near", word.surface

    def events(self, marks: list[tuple[str, str]]) -> Iterator[tuple[str, str, int, bool, bool]]:
        """Kind, surface, reasons, whether it counts as an occurrence, and whether it would if it were the term's first: in the order that makes it first."""
        unknown = {k for k, w in enumerate(self.words) if w.surface in self.unknown}
        for k in sorted(unknown):
            if len(self.words[k].key) >= 3:
                yield "word", self.words[k].surface, BIT["not_in_english_baseline"], True, False
        for run in self.runs(self.text, self.words, unknown):
            yield "run", run, BIT["multiword_non_english"], True, False
        for reason, surface in marks:
            for found, reasons, whole in self.span(reason, surface):
                yield "span", found, reasons, False, whole
        for kind, found in self.definitions():
            yield kind, found, BIT["definition_context"], False, False


GIVEN = ("document", "ordinal", "text", "marks", "unknown", "special")
EVENTS = "term string, document string, ordinal int, at int, whole boolean, surface string, reasons int, n long, surfaces map<string,long>"
OBSERVED = "document string, ordinal int, at int, kind string, term string, surface string, reasons int, counts boolean, whole boolean"


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[tuple]]]:
    """Document, ordinal and events of each passage: at, kind, term, surface, reasons, counts, whole."""
    for batch in in_slices(batches):
        for document, ordinal, text, marks, unknown, special in zip(*(batch.column(c).to_pylist() for c in GIVEN), strict=True):
            passage = Passage(text or "", set(unknown or ()), set(special or ()))
            told = []
            for at, (kind, surface, reasons, counts, whole) in enumerate(passage.events([(m["reason"], m["surface"]) for m in marks or ()])):
                if key := key_of(surface := clean(surface)):
                    told.append((at, kind, key, surface, reasons, counts, whole))
            yield document, ordinal, told


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(schema.types)], schema=schema)


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.int64())]
    schema = pa.schema(list(zip(("term", "document", "ordinal", "at", "whole", "surface", "reasons", "n", "surfaces"), kinds, strict=True)))

    def rows() -> Iterator[tuple]:
        for document, ordinal, told in _passages(batches):
            terms: dict[str, list] = {}
            for at, _, key, surface, reasons, counts, whole in told:
                held = terms.setdefault(key, [at, whole, surface, 0, 0, {}])
                held[3] |= reasons
                held[4] += counts
                held[5][surface] = held[5].get(surface, 0) + counts
            for key, (at, whole, surface, reasons, n, counted) in terms.items():
                yield key, document, ordinal, at, whole, surface, reasons, n, list(counted.items())

    return _in_batches(rows(), schema)


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_()]
    schema = pa.schema(list(zip(("document", "ordinal", "at", "kind", "term", "surface", "reasons", "counts", "whole"), kinds, strict=True)))
    return _in_batches(((document, ordinal, *event) for document, ordinal, told in _passages(batches) for event in told), schema)


def words_of(passages: DataFrame) -> DataFrame:
    """``document``, ``ordinal`` and each distinct ``surface`` of a passage, those in its marked spans included."""
    found = lambda s: F.regexp_extract_all(s, F.lit(TERM), F.lit(0))
    both = F.concat(found(F.coalesce("text", F.lit(""))), F.flatten(F.transform("marks", lambda m: found(m["surface"]))))
    return passages.select("document", "ordinal", F.explode(F.array_distinct(both)).alias("surface"))


def with_marks(passages: DataFrame) -> DataFrame:
    """Passages (``document``, ``ordinal``, ``text``, ``raw`` markup or null) with their marked spans."""
    return passages.select(F.col("document").cast("string").alias("document"), F.col("ordinal").cast("int").alias("ordinal"), "text", marked(F.coalesce("text", F.lit("")), F.coalesce("raw", F.lit(""))).alias("marks"))


def judged(passages: DataFrame, words: DataFrame, **thresholds: float) -> DataFrame:
    """Passages with their marked spans and those of their surfaces that are candidates or special.

    ``words`` is a lexicon. Surfaces are judged once each; the join that takes the judgement back to the passages has one row of each
    surface on its right, so that frequent ones can be split.
    """
    rows = with_marks(passages)
    each = words_of(rows)
    told = layers(each.select("surface").distinct(), words, **thresholds).where("candidate or special")
    pick = lambda flag: F.collect_list(F.when(F.col(flag), F.col("surface")))
    flagged = each.join(told.select("surface", "candidate", "special"), "surface").groupBy("document", "ordinal").agg(pick("candidate").alias("unknown"), pick("special").alias("special"))
    return rows.join(flagged, ["document", "ordinal"], "left").select(*GIVEN)


def events(passages: DataFrame, words: DataFrame, **thresholds: float) -> DataFrame:
    """One row per passage and term that something speaks for: where it is first, reasons as a mask, occurrences and spellings."""
    return judged(passages, words, **thresholds).mapInArrow(_events, EVENTS)


def observed(passages: DataFrame, words: DataFrame, **thresholds: float) -> DataFrame:
    """Every single event in order: words, runs, what marked spans give, subjects of definitions, words near them (``kind``)."""
    return judged(passages, words, **thresholds).mapInArrow(_observed, OBSERVED)


# --- entries ---------------------------------------------------------------------------------


def reason_names(mask: Column) -> Column:
    return F.array_compact(F.array(*(F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(reason)) for reason, bit in BIT.items())))


def entries(found: DataFrame, most: int = 4) -> DataFrame:
    """Glossary entries from events: canonical form, variants, reasons, priority, counts and the first ``most`` places.

    The canonical form is the surface of a term's first event by document, passage and place; a marked span taken as
    a whole counts as an occurrence only if it is that first event. Places are cut to the first few in each task before they are shuffled.
    """
    found = staged(found, "glossary-events")
    first = F.min(F.struct("document", "ordinal", "at", "whole", "surface"))
    each = found.groupBy("term", "document").agg(F.sum("n").alias("n"), F.bit_or("reasons").alias("reasons"), first.alias("first"))
    totals = each.groupBy("term").agg(F.sum("n").alias("n"), F.bit_or("reasons").alias("reasons"), F.min("first").alias("first"), F.count(F.lit(1)).alias("document_count"))
    spelt = found.select("term", F.explode("surfaces").alias("surface", "n")).groupBy("term", "surface").agg(F.sum("n").alias("n"))
    spelt = spelt.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("surface", "n"))).alias("spelt"))
    order = F.row_number().over(Window.partitionBy("term").orderBy("document", "ordinal"))
    places = found.select("term", "document", "ordinal", "reasons").withColumn("k", order).where(F.col("k") <= most)
    places = places.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("document", "ordinal", "reasons"))).alias("places"))
    rows = totals.join(spelt, "term").join(places, "term")
    extra = F.when(F.col("first.whole"), 1).otherwise(0)
    canonical = F.col("first.surface")
    counted = F.transform("spelt", lambda s: F.struct(s["surface"].alias("surface"), (s["n"] + F.when(s["surface"] == canonical, extra).otherwise(0)).alias("n")))
    points = F.lit(0)
    for reason, bit in BIT.items():
        points = points + F.when(F.col("reasons").bitwiseAND(F.lit(bit)) != 0, WEIGHTS[reason]).otherwise(0)
    tokens = F.size(F.split("term", " "))
    return rows.select(
        canonical.alias("canonical_surface_form"),
        F.col("term").alias("normalized_form"),
        F.array_except(F.transform("spelt", lambda s: s["surface"]), F.array(canonical)).alias("variants"),
        reason_names(F.col("reasons")).alias("reason_codes"),
        (points + F.least("document_count", F.lit(5)) + F.least(tokens, F.lit(4))).cast("long").alias("priority_score"),
        F.transform("places", lambda p: F.struct(p["document"].alias("document"), p["ordinal"].alias("paragraph_ordinal"), reason_names(p["reasons"]).alias("reason_codes"))).alias("evidence"),
        "document_count",
        (F.col("n") + extra).alias("frequency"),
        F.map_from_entries(F.filter(counted, lambda s: s["n"] > 0)).alias("surface_frequency"),
        tokens.alias("tokens"),
    )


def with_contexts(glossary: DataFrame, passages: DataFrame) -> DataFrame:
    """Entries whose evidence also has title, anchor and an excerpt of its passage (``passages``: ``document``, ``ordinal``, ``title``, ``anchor``, ``text``)."""
    where = passages.select(F.col("document").cast("string").alias("document"), F.col("ordinal").cast("int").alias("paragraph_ordinal"), "title", "anchor", excerpt(F.coalesce("text", F.lit(""))).alias("context"))
    each = glossary.select("normalized_form", F.explode("evidence").alias("e")).select("normalized_form", "e.*").join(where, ["document", "paragraph_ordinal"], "left")
    told = each.groupBy("normalized_form").agg(F.array_sort(F.collect_list(F.struct("document", "paragraph_ordinal", "title", "anchor", "context", "reason_codes"))).alias("evidence_contexts"))
    return glossary.drop("evidence").join(told, "normalized_form")


def in_order(glossary: DataFrame) -> DataFrame:
    """Entries by priority, documents and words, most first, then by form."""
    return glossary.orderBy(F.desc("priority_score"), F.desc("document_count"), F.desc("tokens"), "normalized_form", "canonical_surface_form")


def build(passages: DataFrame, words: DataFrame, most: int = 4, **thresholds: float) -> DataFrame:
    """The glossary of passages (``document``, ``ordinal``, ``title``, ``anchor``, ``text``, ``raw``) against a lexicon, without order; see ``in_order``.

    Null texts have no terms; a passage that repeats a document and ordinal counts again; documents are told by their names and come in
    their order; extra columns play no part; an empty table has no entries.
    """
    return with_contexts(entries(events(passages, words, **thresholds), most), passages)
