"""Byte-level BPE by a pair occurrence index.

The words of a slab of documents that were not seen before are laid end to end as one symbol
chain. An index maps each mergeable pair to every position where it occurs. Active ranks are
taken in ascending order; each merges all its positions at once and updates the lists of the
neighbouring pairs it has touched. Words never interact, so this gives each word the merges
that encoding it alone would give.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slabs, filled, only

#: Fixed value: the split pattern of byte-level BPE vocabularies of this format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words that a worker remembers before it starts afresh.
WORDS_HELD = 800_000
#: A longer text is split in pieces of about this many characters, at places where no word can span.
PIECE_CHARS = 1_000_000
#: Below so many occurrences a plain loop beats array operations.
FEW = 12

_SPLIT = regex.compile(PATTERN)
#: The same pattern with the classes spelled out for texts within U+0000 to U+024F, where it runs faster.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
_LATIN = re.compile("[\x00-\u024f]*")
_LATIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_SAFE = regex.compile(r"(?<=\S) (?=\p{L})")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else the next free letter from 256."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Words(dict):
    """The number of each word seen so far; an unknown word gets the next one and is noted as fresh."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def tokens_of(piece: str) -> list[str]:
    return (_LATIN_SPLIT if _LATIN.fullmatch(piece) else _SPLIT).findall(piece)


class Codec:
    """Encodes and decodes with one vocabulary file; lives in a worker and keeps a bounded word table."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = _byte_letters()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._added = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
            if self.added
            else None
        )
        pieces: dict[int, bytes] = {i: bytes(letters[c] for c in w) for w, i in vocab.items()}
        pieces |= {i: w.encode() for w, i in self.added.items()}
        table = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.piece_len = np.array([len(p) for p in table], dtype=np.int64)
        self.piece_off = np.concatenate(([0], np.cumsum(self.piece_len)[:-1]))
        self.piece_buf = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.of_byte = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.result = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.left, self.right = left, right
        key = (left << 32) | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank_of = key[order], order
        self._forget()

    def _forget(self) -> None:
        self.words = Words()
        self.flat = np.zeros(0, dtype=np.int32)
        self.start = np.zeros(1, dtype=np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 for pairs that never merge."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank_of[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and where each word starts (one more entry at the end)."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        sym = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        full = sizes > 0
        nxt[ends[full] - 1] = -1
        prv[(ends - sizes)[full]] = -1
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(at: np.ndarray) -> None:
            if not len(at):
                return
            ranks = self._ranks(sym[at], sym[nxt[at]])
            good = ranks >= 0
            at, ranks = at[good], ranks[good]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for i, r in enumerate(ranks[[0, *cuts.tolist()]].tolist()):
                if r not in places:
                    places[r] = []
                    heapq.heappush(active, r)
                places[r].append(at[bounds[i] : bounds[i + 1]])

        index(np.flatnonzero(nxt >= 0))
        while active:
            rank = heapq.heappop(active)
            chunks = places.pop(rank)
            at = _distinct(np.concatenate(chunks)) if len(chunks) > 1 else chunks[0]
            a, b, new = int(self.left[rank]), int(self.right[rank]), int(self.result[rank])
            at = at[(sym[at] == a) & (nxt[at] >= 0)]
            at = at[sym[nxt[at]] == b]
            if a == b or len(at) < FEW:
                done = []
                for p in at.tolist():
                    q = int(nxt[p])
                    if sym[p] != a or q < 0 or sym[q] != b:
                        continue
                    after = int(nxt[q])
                    sym[p], sym[q], nxt[p] = new, -1, after
                    if after >= 0:
                        prv[after] = p
                    done.append(p)
                at = np.array(done, dtype=np.int64)
            else:
                gone = nxt[at]
                after = nxt[gone]
                sym[at], sym[gone], nxt[at] = new, -1, after
                has = after >= 0
                prv[after[has]] = at[has]
            before = prv[at]
            index(_distinct(np.concatenate((before[before >= 0], at[nxt[at] >= 0]))))
        kept = sym >= 0
        counts = np.concatenate(([0], np.cumsum(kept)))
        starts = counts[np.concatenate((ends - sizes, [n]))] if len(words) else np.zeros(1, dtype=np.int64)
        return sym[kept].astype(np.int32), starts.astype(np.int64)

    def _learn(self, fresh: list[str]) -> None:
        ids, starts = self.merge([w.encode("utf-8") for w in fresh])
        self.start = np.concatenate((self.start, starts[1:] + len(self.flat)))
        self.flat = np.concatenate((self.flat, ids))

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE_CHARS:
            cut = _SAFE.search(text, at + PIECE_CHARS)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and, one longer than ``texts``, where each starts."""
        if len(self.words) > WORDS_HELD:
            self._forget()
        number = self.words.__getitem__
        rows: list[list[np.ndarray]] = []
        for text in texts:
            parts: list[np.ndarray] = []
            for i, run in enumerate(self._added.split(text)) if self._added else [(0, text)]:
                if i % 2:
                    parts.append(np.array([-1 - self.added[run]], dtype=np.int32))
                    continue
                for piece in self._pieces(run):
                    tokens = tokens_of(piece)
                    parts.append(np.fromiter(map(number, tokens), dtype=np.int32, count=len(tokens)))
            rows.append(parts)
        if self.words.fresh:
            self._learn(self.words.fresh)
            self.words.fresh = []
        rows_at = np.cumsum([0, *(sum(map(len, parts)) for parts in rows)])
        word = np.concatenate([np.zeros(0, dtype=np.int32), *(p for parts in rows for p in parts)])
        special = word < 0
        at = np.where(special, 0, word)
        size = np.where(special, 1, (self.start[1:] - self.start[:-1])[at] if len(self.start) > 1 else 1)
        first = np.concatenate(([0], np.cumsum(size)))
        ids = np.empty(first[-1], dtype=np.int32)
        step = np.arange(first[-1]) - np.repeat(first[:-1], size)
        source = np.repeat(self.start[at], size) + step
        marked = np.repeat(special, size)
        ids[~marked] = self.flat[source[~marked]]
        ids[marked] = (-1 - word[special]).astype(np.int32)
        return ids, first[rows_at]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a list of ids; bytes that are no UTF-8 become U+FFFD."""
        size = self.piece_len[ids]
        first = np.cumsum(size) - size
        total = int(size.sum())
        source = np.arange(total) + np.repeat(self.piece_off[ids] - first, size)
        return self.piece_buf[source].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs``: the id column and ``ids array<int>``.

    A null text counts as empty and gives an empty list. Repeated rows and null ids are kept as
    they are, other columns are left out. A text of any length is read in pieces. Needs no shuffle.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for slab in by_slabs(batches, "text"):
            ids, starts = c.encode(slab.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([slab.column("id"), lists], ["id", "ids"])

    rows = only(docs, id=id_col, text=text_col).withColumn("text", filled(F.col("text")))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """One row per row: the id column and ``text``, the text of its ids. A null list gives a null text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            lists = batch.column("ids")
            texts = [None if x is None else c.decode(np.asarray(x.values)) for x in lists] if len(lists) else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    picked = only(rows, id=id_col, ids=ids_col)
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Encodes each text and decodes the ids again in the same task: id, ``ids array<int>``, ``decoded string``.

    The same rules as ``encode`` hold.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for slab in by_slabs(batches, "text"):
            ids, starts = c.encode(slab.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            texts = pa.array((c.decode(ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)), pa.string())
            yield pa.RecordBatch.from_arrays([slab.column("id"), lists, texts], ["id", "ids", "decoded"])

    rows = only(docs, id=id_col, text=text_col).withColumn("text", filled(F.col("text")))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
