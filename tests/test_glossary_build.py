"""The glossary build against a plain walk over the passages, one event after the other."""

import html
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import glossary as G
from lexmill.operators import glossary_build as B

WORD = re.compile(r"[^\W_̀-ͯ][^\W_]*(?:['’][^\W_̀-ͯ][^\W_]*)?")
MARKS = str.maketrans("", "", " \t\r\n.,;:!?()[]{}\"“”‘’'")


def fold(s):
    s = " ".join(html.unescape(s).replace("’", "'").replace("‘", "'").split())
    return " ".join("".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).casefold().split()).strip(" \t\r\n.,;:!?()[]{}\"'“”‘’")


def tidy(s):
    return " ".join(html.unescape(s).split()).strip(" \t\r\n.,;:!?()[]{}\"“”‘’")


def forms(word):
    out = {word} | ({G.IRREGULAR[word]} if word in G.IRREGULAR else set())
    return out | {word[: -len(s)] + put for s, put, n in G.SUFFIXES if word.endswith(s) and len(word) >= n}


def origins(word):
    if not re.fullmatch("[a-z]{7,}", word):
        return set()
    return {word[: -len(s)] + put for s, put, n in G.DERIVED if word.endswith(s) and len(word) >= n} - {word}


class Plain:
    """Everything in one place, every occurrence kept."""

    def __init__(self, listed, score, limits=(2.5, 2.0, 1.0)):
        self.listed, self.score, self.limits = listed, score, limits
        self.log = []

    def english(self, key, surface):
        top = max((self.score.get(f, 0) for f in forms(key)), default=0)
        if forms(key) & self.listed or top >= self.limits[0]:
            return True
        return bool(re.fullmatch("[A-Za-z]+", surface)) and top >= self.limits[2] and any(self.score.get(f, 0) >= self.limits[1] for f in origins(key))

    def unknown(self, surface, least):
        key = fold(surface)
        if len(key) < least or not any(c.isalpha() for c in surface) or self.english(key, surface):
            return False
        return not (key.endswith("'s") and self.english(key[:-2], surface))

    def special(self, surface):
        marks = any(unicodedata.combining(c) for c in unicodedata.normalize("NFD", surface))
        return self.unknown(surface, 2) or marks or 0 < max(self.score.get(f, 0) for f in forms(fold(surface))) < self.limits[0]

    def add(self, where, surface, reasons, counts=False, if_new=False):
        key = fold(tidy(surface))
        if key:
            new = if_new and all(e[0] != key for e in self.log)
            self.log.append((key, tidy(surface), where, frozenset(reasons), counts or new))

    def runs(self, text, matches, good):
        group = []
        for m in [*matches, None]:
            if m is not None and good(m) and (not group or re.fullmatch(r"[\s/-]+", text[group[-1].end() : m.start()])):
                group.append(m)
                continue
            if len(group) > 1:
                yield text[group[0].start() : group[-1].end()]
            group = [m] if m is not None and good(m) else []

    def passage(self, where, text, raw):
        words = list(WORD.finditer(text))
        for m in words:
            if self.unknown(m[0], 3):
                self.add(where, m[0], ["not_in_english_baseline"], True)
        for run in self.runs(text, words, lambda m: self.unknown(m[0], 2)):
            self.add(where, run, ["multiword_non_english"], True)
        spans = [("quoted", m[1]) for m in re.finditer(r'["“]([^"”\n]{1,240})["”]', text)]
        spans += [("quoted", m[1]) for m in re.finditer(r"(?<!\w)['‘]([^'’\n]{1,240})['’](?!\w)", text) if re.search(r"\s", m[1])]
        spans += [("italic", s) for m in re.finditer(r"(?is)<(?:i|em)\b[^>]*>(.*?)</(?:i|em)\s*>", raw or "") if (s := " ".join(html.unescape(re.sub("<[^>]*>", "", m[1])).split()))]
        cues = list(re.finditer(G.DEFINES, text, re.I))
        for reason, span in spans:
            inner = list(WORD.finditer(span))
            odd = [m for m in inner if self.special(m[0])]
            near = any(abs(c.start() - m.end()) <= 72 or abs(m.start() - c.end()) <= 72 for m in re.finditer(re.escape(span), text, re.I) for c in cues)
            if not odd and near:
                odd = inner
            if not odd:
                continue
            pair = reason == "italic" or len(inner) == 2
            one = len(inner) <= 8 and (len(odd) == len(inner) or near or (pair and any(self.unknown(m[0], 2) for m in inner)))
            if one or (pair and 2 <= len(inner) <= 4):
                self.add(where, span, [reason], if_new=True)
                continue
            for m in odd:
                self.add(where, m[0], [reason])
            places = {m.start() for m in odd}
            for run in self.runs(span, inner, lambda m: m.start() in places):
                self.add(where, run, [reason, "multiword_non_english"])
        subjects = [self.subject(text, words, c.start()) for c in cues]
        done = set()
        for s in subjects:
            if len(s) > 1 and (s[0].start(), s[-1].end()) not in done:
                done.add((s[0].start(), s[-1].end()))
                self.add(where, text[s[0].start() : s[-1].end()], ["definition_context"])
        done = set()
        for c, s in zip(cues, subjects):
            for m in words:
                gap = c.start() - m.end() if m.end() <= c.start() else m.start() - c.end() if m.start() >= c.end() else 0
                if fold(m[0]) not in B.STOPS and (self.unknown(m[0], 2) or m in s) and gap <= 72 and m.start() not in done:
                    done.add(m.start())
                    self.add(where, m[0], ["definition_context"])

    def subject(self, text, words, cue):
        out = []
        for m in [w for w in words if w.end() <= cue][::-1]:
            if cue - m.end() > 72 or (out and re.search("[.!?;:]", text[m.end() : out[0].start()])):
                break
            if not out and fold(m[0]) in B.BRIDGES:
                continue
            if fold(m[0]) in B.STOPS:
                break
            out = [m, *out]
            if len(out) == 8:
                break
        return out

    def glossary(self, most=4):
        by = defaultdict(list)
        for e in self.log:
            by[e[0]].append(e)
        out = {}
        for key, seen in by.items():
            reasons = set().union(*(e[3] for e in seen))
            places = list(dict.fromkeys(e[2] for e in seen))[:most]
            documents = len({e[2][0] for e in seen})
            points = sum(G.WEIGHTS[r] for r in reasons) + min(documents, 5) + min(len(key.split()), 4)
            evidence = sorted((*p, sorted(set().union(*(e[3] for e in seen if e[2] == p)))) for p in places)
            counted = Counter(e[1] for e in seen if e[4])
            out[key] = (seen[0][1], sorted({e[1] for e in seen} - {seen[0][1]}), sorted(reasons), points, evidence, documents, sum(counted.values()), dict(counted))
        return out


def built(spark, passages, listed, score, **limits):
    rows = spark.createDataFrame([(d, o, f"Title {d}", str(o), t, r) for d, o, t, r in passages], "document string, ordinal int, title string, anchor string, text string, raw string")
    lists = spark.createDataFrame([(w,) for w in listed] or [("",)], "word string")
    ranked = spark.createDataFrame(list(score.items()), "word string, zipf double") if score else None
    return B.build(rows, B.lexicon(lists, ranked), **limits)


def as_plain(rows):
    return {
        r["normalized_form"]: (
            r["canonical_surface_form"], r["variants"], r["reason_codes"], r["priority_score"], [(e["document"], e["paragraph_ordinal"], e["reason_codes"]) for e in r["evidence_contexts"]],
            r["document_count"], r["frequency"], r["surface_frequency"],
        )
        for r in rows
    }


LISTED = set("the a of is and to in word means self human dog story called known as mind his it was great read common creation".split())
SCORE = {"common": 5.0, "rare": 1.7, "reverberate": 3.0, "reverberated": 1.2, "nation": 4.0, "spoken": 2.6, "walk": 6.1}
PASSAGES = [
    ("a.html", 0, 'The word "Ātma" means the self. In jñāna-mārga practice, dharma is called the way of human creation; "known word" is common.', None),
    ("a.html", 1, "Sādhanā / sādhana sadhana, the dog's story and the guru's story. His great mind: samskāra vikāra is known as the rare common mind.", "His great <i>mind</i> and <em class='x'>samskāra <b>vikāra</b></em> or <i></i>"),
    ("b.html", 0, "He said 'read the story' and ‘brahma cakra’, reverberated walks. ATMA Atma ātma; \"a long quoted word of the story and dharma cakra in the mind of the dog and human\"", "<i>the common walk</i> &amp; <i>common dog</i>"),
    ("c.html", 0, None, None),
    ("c.html", 1, "", ""),
    ("d.html", 0, "dharma dharma dharma-cakra. Dharma means duty. 42 7x l'amour &amp; \"R&amp;D lab\" \"...\" 'x y'", None),
]


def test_same_as_a_plain_walk(spark):
    for score, limits in ((SCORE, {}), ({}, {}), (SCORE, {"common": 6.0, "derived_from": 4.0, "derived_self": 1.0})):
        plain = Plain(LISTED, score, (limits.get("common", 2.5), limits.get("derived_from", 2.0), limits.get("derived_self", 1.0)))
        for p in PASSAGES:
            plain.passage((p[0], p[1]), p[2] or "", p[3])
        assert as_plain(built(spark, PASSAGES, LISTED, score, **limits).collect()) == plain.glossary()


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(spark, seed):
    r = random.Random(seed)
    pieces = [*LISTED, *SCORE, "dharma", "Dharma", "ātma", "guru’s", "dog's", "vikāra", "x", "ab", "7", "한국", "ﬁne", "straße", "STRASSE"]
    marks = ["means", "is called", "also known as", "refers  to"]

    def some():
        words = [r.choice(marks) if r.random() < 0.1 else r.choice(pieces) for _ in range(r.randint(0, 40))]
        text = "".join(w + r.choice([" ", " ", " ", " ", "-", "/", ", ", ". ", ' "', '" ', " '", "' ", "\n", "; "]) for w in words)
        raw = re.sub(r"(\w+ \w+)", lambda m: f"<i>{m[1]}</i>" if r.random() < 0.2 else m[1], text)
        return text, raw

    passages = [(f"d{k // 3:02d}", k % 3, *some()) for k in range(30)]
    plain = Plain(LISTED, SCORE)
    for p in passages:
        plain.passage((p[0], p[1]), p[2], p[3])
    assert as_plain(built(spark, passages, LISTED, SCORE).collect()) == plain.glossary()


def test_order_title_and_context(spark):
    rows = B.in_order(built(spark, PASSAGES, LISTED, SCORE)).collect()
    keys = [(-r["priority_score"], -r["document_count"], -len(r["normalized_form"].split()), r["normalized_form"]) for r in rows]
    assert keys == sorted(keys)
    first = rows[0]["evidence_contexts"][0]
    assert first["title"] == f"Title {first['document']}" and first["context"] in {" ".join(p[2].split()) for p in PASSAGES if p[2]}


def test_layers_are_named(spark):
    words = B.lexicon(spark.createDataFrame([("dog",), ("",), (None,)], "word string"), spark.createDataFrame([*SCORE.items(), ("debilitate", 3.0), ("debilitation", 1.2)], "word string, zipf double"))
    rows = spark.createDataFrame([(s,) for s in ("dog", "dogs", "Common", "reverberated", "debilitation", "Debilitatión", "dog's", "dog’s", "guru", "rare", "x", "12")], "surface string")
    found = {r["surface"]: (r["layer"], r["candidate"], r["special"]) for r in B.layers(rows, words).collect()}
    assert found == {
        "dog": ("list", False, False), "dogs": ("list", False, False), "Common": ("frequency", False, False), "reverberated": ("frequency", False, False), "debilitation": ("derivation", False, True), "Debilitatión": (None, True, True),
        "dog's": ("possessive", False, False), "dog’s": ("possessive", False, False), "guru": (None, True, True), "rare": (None, True, True), "x": (None, False, False), "12": (None, False, False),
    }


def test_zipf_has_a_floor(spark):
    counts = spark.createDataFrame([("the", 900), ("dog", 99), ("odd", 1)], "word string, n long")
    assert {r["word"]: r["zipf"] for r in B.zipf(counts, 7.0).collect()} == {"the": 8.95, "dog": 8.0}


def test_empty_table(spark):
    assert built(spark, PASSAGES[3:5], LISTED, SCORE).count() == 0


def test_hangul_is_taken_apart_in_columns_as_in_queries(spark):
    texts = ["한국 뉴스 plain", "각", "가힣", "ÀÉ한", "plain", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == {t: T.plain(t) for t in texts}
