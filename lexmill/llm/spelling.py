"""Spelling variants: words of a vocabulary at one edit from each other, found with a bit-sliced position index.

The index of a block of words holds, for each (position, letter), a whole number whose bit k tells whether word k
of the block has this letter there. A word is looked up by a recurrence over its letters that moves four sets of
words forward at once, each by a few operations on all words of the block together: those without an error so far,
and those with one replaced, one lacking or one further letter, the last two at shifted positions.

How it is spread: two words at one edit share the first half of the shorter one or its other half, so words meet
in groups of equal halves. A block takes whole groups, or a part of a group that is too large for one; the words of such
a group are looked up in each of its parts. No pairs leave a block: each word comes out with its number of near
words there and the best of them, and these are summed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, filled, only, written

#: Constant: a run of letters of five or more code points.
RUN = "[A-Za-zÀ-ÿ]{5,}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one index at most: the size of its whole numbers in bits.
BLOCK = 4096


def lower_latin(word: Column) -> Column:
    """A-Z lower-cased, all other letters left alone."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def damaged(doc_id: Column, word: Column, every: int = 97) -> Column:
    """The word, without one code point where ``every`` divides the CRC-32 of ``<doc_id>:<word>``."""
    h = F.crc32(F.concat(filled(doc_id), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))).otherwise(word)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3) -> DataFrame:
    """``word`` and ``n`` of the damaged lower-cased runs of all whole texts, if of five code points and ``least`` occurrences.

    Runs under five code points can give no such word and are left out by the pattern. Null texts have no runs,
    a null id counts as the empty text. Words are summed in each task before they are shuffled, so that one
    that is everywhere costs one row a task.
    """
    runs = only(docs, id=id_col, text=text_col).select("id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select("id", lower_latin(F.col("run")).alias("run")).select(damaged(F.col("id"), F.col("run")).alias("word"))
    return words.where(F.length("word") >= 5).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


class PositionIndex:
    """Bit-sliced position index over a block of words."""

    def __init__(self, words: list[str]) -> None:
        slices: dict[tuple[int, str], int] = defaultdict(int)
        length: dict[int, int] = defaultdict(int)
        for k, word in enumerate(words):
            bit = 1 << k
            for place in enumerate(word):
                slices[place] |= bit
            length[len(word)] |= bit
        self.slices, self.length = dict(slices), dict(length)
        self.longer = [0] * (max(length, default=0) + 1)  # longer[i]: words of more than i letters
        for n, bits in length.items():
            for i in range(n):
                self.longer[i] |= bits

    def near(self, word: str) -> int:
        """The words, as bits, that differ from ``word`` by exactly one inserted, deleted or replaced letter."""
        slices, longer = self.slices.get, self.longer
        top = len(longer)
        exact = longer[0] if top else 0
        replaced = lacking = 0
        further = exact
        for i, letter in enumerate(word):
            here = slices((i, letter), 0)
            after = slices((i + 1, letter), 0)
            before = slices((i - 1, letter), 0)
            old = exact
            exact &= here
            replaced = replaced & here | (old & longer[i] ^ exact if i < top else 0)
            lacking = lacking & before | old
            further = further & after | (exact & longer[i + 1] if i + 1 < top else 0)
        m = len(word)
        return replaced & self.length.get(m, 0) | lacking & self.length.get(m - 1, 0) | further & self.length.get(m + 1, 0)


def bits_of(found: int) -> Iterator[int]:
    while found:
        low = found & -found
        yield low.bit_length() - 1
        found ^= low


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and part; a block's words are looked up in the index of its members."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    held: list[tuple] = []  # (group, word, n, member, asks)

    def close() -> pa.RecordBatch:
        members = [r for r in held if r[3]]
        index = PositionIndex([r[1] for r in members])
        seen: dict[str, list] = {}

        def met(word: str, other: str, n: int) -> None:
            now = seen.setdefault(word, [0, -n, other])
            now[0] += 1
            now[1:] = min(now[1:], [-n, other])

        for group, word, n, _, asks in held:
            if not asks:
                continue
            short, kind, _, _ = group
            half = short // 2
            for k in bits_of(index.near(word)):
                other_group, other, other_n, _, other_asks = members[k]
                if other_group != group or (kind == 1 and other[:half] == word[:half]):
                    continue  # of another group of the block, or a pair that the group of first halves has
                met(word, other, other_n)
                if not other_asks:  # a longer word doesn't ask in this group
                    met(other, word, n)
        held.clear()
        rows = [(w, c, -n, o) for w, (c, n, o) in seen.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.types[k]) for k in range(4)], schema=schema)

    key, start, count = None, 0, 0  # rows of the group that is being read begin at start
    for batch in batches:
        for short, kind, half, part, word, n, member, asks in zip(*(batch.column(c).to_pylist() for c in ("short", "kind", "half", "part", "word", "n", "member", "asks")), strict=True):
            group = (short, kind, half, part)
            if group != key:
                if count >= BLOCK // 2:
                    yield close()
                    count = 0
                key = group
            count += member
            held.append((group, word, n, member, asks))
    if held:
        yield close()


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and ``best_n``, ``best`` of every word of ``words`` (``word``, ``n``; distinct) that has near ones.

    ``best`` is the near word of the largest n, of equal ones the smallest in code-point order.
    """
    length = F.length("word")
    side = lambda short: F.array(
        F.struct(short.alias("short"), F.lit(0).alias("kind"), F.left("word", F.floor(short / 2).cast("int")).alias("half")),
        F.struct(short.alias("short"), F.lit(1).alias("kind"), F.right("word", short - F.floor(short / 2).cast("int")).alias("half")),
    )
    each = words.select("word", "n", F.explode(F.concat(side(length), side(length - 1))).alias("g"))
    each = each.select("g.short", "g.kind", "g.half", "word", "n", (length == F.col("g.short")).alias("asks"))
    group = ["short", "kind", "half"]
    # groups without a word that asks find nothing; those too large for a block are cut into parts
    sizes = each.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.max("asks").alias("asked")).where(F.col("asked") & (F.col("rows") > 1))
    sized = each.join(sizes.select(*group, F.ceil(F.col("rows") / BLOCK).cast("int").alias("parts")), group)
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    parts = F.when(F.col("asks") & (F.col("parts") > 1), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    sized = sized.withColumn("own", own).withColumn("part", F.explode(parts)).withColumn("member", F.col("part") == F.col("own"))
    keys = [*group, "part"]
    met = sized.select(*keys, "word", "n", "member", "asks").repartition(*keys).sortWithinPartitions(*keys)
    met = met.mapInArrow(_meet, "word string, n_near long, best_n long, best string")
    met = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b"))
    return met.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: the end of the chain of forms of every word that has one (``word``, ``form``).

    Forms occur twice as often as their words or more, so chains are short and never closed; each round doubles
    the steps already taken.
    """
    scratch = Scratch()
    now = scratch.written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "spelling-roots")
    while now.where("open").limit(1).count():
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = scratch.written(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "spelling-roots")
    out = written(now.select("word", "root"), "spelling-root")
    scratch.drop()
    return out


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, times: int = 2) -> DataFrame:
    """Every word of the vocabulary of ``docs``: ``word``, ``n``, ``form``, ``form_n``, ``n_near`` and ``root``.

    ``form`` is the near word of the largest n, if that is ``times`` the word's own or more, else null; ``root`` is
    where the chain of forms ends, the word itself where it has none. Null and empty texts give no words, an
    empty table no rows; very long texts are read whole; repeated rows count as often as they stand there, and
    of equally frequent near words the smallest in code-point order is taken; other columns play no part.
    """
    words = written(vocabulary(docs, id_col, text_col, least), "spelling-words")
    near = near_words(words)
    told = words.join(near, "word", "left")
    has = F.col("best_n") >= times * F.col("n")
    told = written(
        told.select("word", "n", F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")),
        "spelling-forms",
    )
    ends = roots(told.where(F.col("form").isNotNull()).select("word", "form"))
    return told.join(ends, "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))
