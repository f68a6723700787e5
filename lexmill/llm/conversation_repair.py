"""Conversation structure repair: the cheapest edits after which the roles of a conversation alternate.

Edits and their costs: Keep 0, Rerole to user or assistant 1, Delete 2 (blank rows and duplicates must go), Insert an
empty turn 5; a truncated row that is not deleted costs 5 more. Roles must then read ``(s?(ua)+)?`` by their first
letters. The search runs over the rows in order with four states. The edits so far, the audit, are a path of linked
nodes that states share; each node knows its ancestors at powers of two and a rolling hash of its whole path, so that of
two equally cheap audits the first difference is found by a binary search. Equal hashes are verified by walking the
paths until they meet, and what is verified once is not walked again.

How it is spread: a conversation's rows are read in order by one task, as the digest of the repaired text, a chain over
all of it, asks for anyway, but they stream: rows are sorted by Spark, which spills, what all living paths share is handed on
and forgotten, and of what they don't share a byte an edit is kept. The search reads a few bytes of a row, not its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import only, written

#: Prices of edits, and of leaving a truncated row in.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: state: what an initial leads to. 0 nothing yet, 1 system, 2 waits for the assistant, 3 whole.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = {"u": "user", "a": "assistant"}
#: state: the initial that a new role gets there, and the state after it.
TURN = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
BLANK, DUPLICATE, CUT, GONE = 1, 2, 3, 4
#: Nodes after which what all living paths share is handed on.
FLUSH = 4096
#: The place of a conversation's summary, behind all its rows.
LAST = (1 << 62) + 1
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Audits:
    """Strings of edits as linked nodes; node 0 is the empty string."""

    def __init__(self, base: int = 1_000_003, modulus: int = (1 << 61) - 1) -> None:
        self.base, self.modulus = base, modulus
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[0]]
        self.twin: dict[int, int] = {}

    def add(self, parent: int, letter: str) -> int:
        up = [parent]
        while self.depth[parent] + 1 >= 2 << len(up) - 1:  # the ancestor at 2 ** k, from that at 2 ** (k - 1)
            up.append(self.up[up[-1]][len(up) - 1])
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * self.base + ord(letter)) % self.modulus)
        self.up.append(up)
        return len(self.up) - 1

    def above(self, node: int, depth: int) -> int:
        while (gap := self.depth[node] - depth) > 0:
            node = self.up[node][gap.bit_length() - 1]
        return node

    def _first(self, node: int) -> int:
        while node in self.twin:
            node = self.twin[node]
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of equal depth are equal strings: letter by letter until their paths meet."""
        x, y = self._first(a), self._first(b)
        low, high = min(x, y), max(x, y)
        while x != y:
            if self.letter[x] != self.letter[y]:
                return False
            x, y = self._first(self.up[x][0]), self._first(self.up[y][0])
        if low != high:
            self.twin[high] = low
        return True

    def path(self, node: int, root: int = 0) -> str:
        letters = []
        while node != root:
            letters.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(letters))

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.above(a, depth), self.above(b, depth)
        if self.hash[x] == self.hash[y]:
            return self.depth[a] < self.depth[b] if self.same(x, y) else self.path(a) < self.path(b)
        for k in range(len(self.up[x]) - 1, -1, -1):  # the highest ancestors that still differ
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if not self.same(self.up[x][0], self.up[y][0]):
            return self.path(a) < self.path(b)
        return self.letter[x] < self.letter[y]


class Rope:
    """Edits that some living paths begin with and that no comparison needs any more: one byte an edit."""

    def __init__(self, above: Rope | None, text: str) -> None:
        self.above, self.text, self.depth = above, text.encode(), above.depth + 1 if above else 0

    def whole(self) -> str:
        parts, rope = [], self
        while rope:
            parts.append(rope.text)
            rope = rope.above
        return b"".join(reversed(parts)).decode()


class Search:
    """The cheapest audit of one conversation; rows go in by ``row``, edits come out as soon as they are certain.

    Once enough nodes are held, what lies behind the living ones is packed into ropes. Which of two living paths comes first
    is settled by then, unless one begins the other, and is kept as the letter of the node that each goes on from.
    """

    def __init__(self, audits: type[Audits] = Audits) -> None:
        self.make, self.audits = audits, audits()
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self.roots = {0: Rope(None, "")}
        self._inserts()

    def _better(self, old: tuple[int, int] | None, cost: int, parent: int, letter: str) -> tuple[int, int]:
        if old and old[0] < cost:
            return old
        node = self.audits.add(parent, letter)
        return old if old and old[0] == cost and self.audits.less(old[1], node) else (cost, node)

    def _inserts(self) -> None:
        best = self.best
        for state in (0, 1, 3, 2):  # to 2 from all others, then to 3
            if best[state]:
                to = TURN[state][1]
                best[to] = self._better(best[to], best[state][0] + INSERT, best[state][1], "I")

    def row(self, initial: str, fault: int) -> None:
        new: list[tuple[int, int] | None] = [None] * 4
        extra = TRUNCATED if fault == CUT else 0
        for state, held in enumerate(self.best):
            if held is None:
                continue
            cost, node = held
            new[state] = self._better(new[state], cost + DELETE, node, "D")
            if fault in (BLANK, DUPLICATE):
                continue
            to = NEXT[state].get(initial)
            if to is not None:
                new[to] = self._better(new[to], cost + extra, node, "K")
            to = TURN[state][1]
            new[to] = self._better(new[to], cost + REROLE + extra, node, "R")
        self.best = new
        self._inserts()

    def _root(self, node: int) -> int:
        while node not in self.roots:
            node = self.audits.up[node][0]
        return node

    def certain(self) -> str:
        """Edits that all living paths begin with, once enough nodes are held; they are forgotten here."""
        if len(self.audits.up) < FLUSH:
            return ""
        old, living = self.audits, {held[1] for held in self.best if held}
        over = {}  # living nodes that another living one goes on from, and the first of them
        for node in living:
            top, here = node, node
            while here not in self.roots:
                here = old.up[here][0]
                if here in living:
                    top = here
            over[node] = top
        tops = sorted(set(over.values()), key=cmp_to_key(lambda a, b: -1 if old.less(a, b) else 1))
        ropes = [Rope(self.roots[r := self._root(n)], old.path(n, r)) for n in tops]
        self.audits = self.make()
        places = [self.audits.add(0, chr(1 + rank)) for rank in range(len(tops))]
        moved = dict(zip(tops, places, strict=True))
        for node in sorted(living - set(tops)):  # a path below its top is inserted turns alone
            for letter in old.path(node, over[node]):
                moved[node] = self.audits.add(moved.get(node, moved[over[node]]), letter)
        self.best = [held and (held[0], moved[held[1]]) for held in self.best]
        self.roots = dict(zip(places, ropes, strict=True))
        while len(set(map(id, ropes))) > 1:  # back to what all of them share
            deepest = max(range(len(ropes)), key=lambda k: ropes[k].depth)
            ropes[deepest] = ropes[deepest].above
        out = ropes[0].whole()
        ropes[0].above, ropes[0].text = None, b""
        return out

    def end(self) -> tuple[int, str]:
        """The cost of the cheapest audit and the edits that are not out yet."""
        ends = [held for held in (self.best[0], self.best[3]) if held]
        cost = min(held[0] for held in ends)
        nodes = [held[1] for held in ends if held[0] == cost]
        node = nodes[1] if len(nodes) > 1 and self.audits.less(nodes[1], nodes[0]) else nodes[0]
        root = self._root(node)
        return cost, self.roots[root].whole() + self.audits.path(node, root)


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``gone`` of turns damaged by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row (``gone``), 1 empties its text, 2 removes full stops, exclamation and question marks, 3 repeats it, 4
    makes its role user. Nulls count as one space; rows are not filtered, so that no conversation is lost.
    """
    rows = only(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("kind", F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(spaced("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def lines(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``, ``gone``) with their places and faults.

    Rows of a conversation are in the order of turns, nulls first, rows of one turn by role and text. A row is a duplicate if an earlier one of its
    conversation has its role and text, told by their digest. Gone rows come first and only keep a conversation's id.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), F.when(F.col("gone"), "").otherwise(space("text")).alias("text"), "gone")
    rows = rows.withColumn("key", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).repartition("conv_id")
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("gone"), F.asc_nulls_first("turn"), "role", "text")).cast("long"))
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "key").orderBy("at")) > 1
    said = lambda text: F.regexp_replace(text, r"[\x20\x09-\x0D]+\z", "")
    fault = F.when(F.col("gone"), GONE).when(said(F.col("text")) == "", BLANK).when(again, DUPLICATE).when(~F.right(said(F.col("text")), F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)
    return rows.select("conv_id", "at", "turn", "role", "text", fault.alias("fault"))


class _Conversation:
    """What one conversation has shown so far."""

    def __init__(self) -> None:
        self.search, self.ready, self.state = Search(), "", 0
        self.first, self.initials = 0, bytearray()  # rows whose edits aren't certain: the place of the first, and a letter of each
        self.turns: list[int] = [0, 0, 0]  # least, largest, how many
        self.faults, self.illegal, self.last = [0, 0, 0, 0], 0, None

    def row(self, at: int, turn: int | None, initial: str, fault: int) -> None:
        if fault == GONE:
            return
        if turn is not None and (not self.turns[2] or turn != self.turns[1]):
            self.turns = [self.turns[0] if self.turns[2] else turn, turn, self.turns[2] + 1]
        self.faults[fault] += 1
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if not self.initials:
            self.first = at
        self.initials += initial.encode() if initial in ("s", "u", "a") else b"-"
        self.search.row(initial, fault)

    def edits(self, letters: str) -> Iterator[tuple[int, str, str]]:
        """Place, edits and new initials of the rows whose edits these letters complete; what follows them waits."""
        letters = self.ready + letters
        start, done, state, put = 0, 0, self.state, ""
        for k, letter in enumerate(letters):
            if letter in "IR":
                initial, state = TURN[state]
                put += initial
            else:
                put += "."
                if letter == "K":
                    state = NEXT[state][chr(self.initials[done])]
            if letter != "I":
                yield self.first + done, letters[start : k + 1], put
                start, done, put, self.state = k + 1, done + 1, "", state
        del self.initials[:done]
        self.first += done
        self.ready = letters[start:]

    def close(self) -> tuple[str, str, tuple[int, ...], list[tuple[int, str, str]]]:
        """Edits behind the last row, their initials, the summary, and the rows that were still waiting."""
        cost, letters = self.search.end()
        rows = list(self.edits(letters))
        state, put = self.state, ""
        for _ in self.ready:
            initial, state = TURN[state]
            put += initial
        least, largest, distinct = self.turns
        gaps = min(largest - least + 1 - distinct, (1 << 63) - 1) if distinct else 0
        return self.ready, put, (gaps, *self.faults[1:4], self.illegal, cost), rows


FIELDS = ("conv_id", "at", "edits", "put", *COUNTS)


def _walk(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Edits of the rows and a summary of each conversation, from rows sorted by conversation and place."""
    out: list[tuple] = []
    none = (None,) * len(COUNTS)
    key: object = FIELDS  # no conversation yet
    now = _Conversation()

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(schema.types)], schema=schema)
        out.clear()
        return made

    def close() -> None:
        behind, put, counts, rows = now.close()
        out.extend((key, *row, *none) for row in rows)
        out.append((key, LAST, behind, put, *counts))

    for given in batches:
        for conv_id, at, turn, initial, fault in zip(*(given.column(c).to_pylist() for c in ("conv_id", "at", "turn", "initial", "fault")), strict=True):
            if key is FIELDS or conv_id != key:
                if key is not FIELDS:
                    close()
                key, now = conv_id, _Conversation()
            now.row(at, turn, initial, fault)
            if letters := now.search.certain():
                out.extend((key, *row, *none) for row in now.edits(letters))
            if len(out) >= FLUSH:
                yield batch()
    if key is not FIELDS:
        close()
        yield batch()


def _with_edits(rows: DataFrame) -> DataFrame:
    """The rows of ``lines`` and, before each, its edits, in order within partitions; behind each conversation its summary."""
    kind = rows.schema["conv_id"].dataType
    small = rows.select("conv_id", "at", "turn", F.left("role", F.lit(1)).alias("initial"), "fault").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    spark_schema = f"conv_id {kind.simpleString()}, at long, edits string, put string, " + ", ".join(f"{c} long" for c in COUNTS)
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("at", pa.int64()), ("edits", pa.string()), ("put", pa.string()), *((c, pa.int64()) for c in COUNTS)])
    edits = small.mapInArrow(lambda batches: _walk(batches, schema), spark_schema)
    both = rows.where(F.col("fault") != GONE).select("conv_id", "at", "role", "text").unionByName(edits, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at", F.col("edits").isNull())


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conversation, edit, role, text, counts)`` one after the other; counts come once, behind a conversation's edits."""
    edits = put = ""
    for given in batches:
        columns = [given.column(c).to_pylist() for c in ("conv_id", "at", "edits", "put", "role", "text", *COUNTS)]
        for conv_id, at, its_edits, its_put, role, text, *counts in zip(*columns, strict=True):
            if its_edits is not None:
                edits, put = its_edits, its_put
                for initial in put if at == LAST else put[:-1]:
                    yield conv_id, "I", ROLE[initial], "", None
                if at == LAST:
                    yield conv_id, "", None, None, counts
            else:
                yield conv_id, edits[-1], ROLE.get(put[-1], role), text, None


def repair(turns: DataFrame) -> DataFrame:
    """Every edit of every conversation: ``conv_id``, ``step`` from 1, ``edit``, ``role`` and ``text`` after it.

    ``turns`` has ``conv_id``, ``turn``, ``role``, ``text`` and ``gone`` (see ``damage``); other columns play no part.
    The repaired conversation is the rows whose edit isn't Delete. Null roles and texts count as one space, null
    turns come first, a null ``conv_id`` is a conversation of its own; a role without initial fits nowhere. Repeated
    rows are duplicates and go; rows of one turn stand by role and text; very long texts pass through whole. A conversation
    without rows has no edits, an empty table gives none. Of equally cheap audits the least in ASCII order counts.
    """
    rows = written(lines(turns), "repair-lines")
    kind = rows.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("step", pa.int64()), *((c, pa.string()) for c in ("edit", "role", "text"))])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, step, size = FIELDS, 0, 0
        for conv_id, edit, role, text, counts in _steps(batches):
            if counts is not None:
                key, step = FIELDS, 0
                continue
            step = step + 1 if key == conv_id else 1
            key = conv_id
            out.append(dict(zip(schema.names, (conv_id, step, edit, role, text), strict=True)))
            size += len(text)
            if len(out) >= FLUSH or size > 4_000_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return _with_edits(rows).mapInArrow(steps, f"conv_id {kind.simpleString()}, step long, edit string, role string, text string")


def audit(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, the counts of its faults, the cost, the audit and ``repaired_sha256``.

    See ``repair``. ``gaps`` counts turns that are missing between the first and the last, ``illegal`` neighbours whose
    initials don't follow each other. The digest is that of ``role:text`` of the repaired rows, joined by line ends; a
    conversation without rows has zeros, an empty audit and the digest of the empty string.
    """
    rows = written(lines(turns), "repair-lines")
    kind = rows.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        digest, letters, first = hashlib.sha256(), [], True
        for conv_id, edit, role, text, counts in _steps(batches):
            if counts is not None:
                out.append(dict(zip(schema.names, (conv_id, *counts, "".join(letters), digest.hexdigest()), strict=True)))
                digest, letters, first = hashlib.sha256(), [], True
                if len(out) >= FLUSH:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
                continue
            letters.append(edit)
            if edit != "D":
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return _with_edits(rows).mapInArrow(audits, f"conv_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")
