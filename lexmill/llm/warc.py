"""WARC archives with a two-level capture index.

``archive`` writes one gzip member per record into WARC files in a shared folder and notes where
each lies. ``build_index`` range-sorts the captures by reversed-host URL key, packs them into
compressed blocks and keeps a sparse directory with the first entry of each block. ``lookup`` finds
keys by binary search in the list of parts, in a part's directory and in a block, and then reads
just the records' byte ranges.

The folder may be any URI that ``pyarrow.fs`` opens. A task that runs twice writes a second file
under another name; the index knows only the files of the attempt that counted.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_slabs, filled, new_path, only, written
from .url_filters import UPPER

#: Smaller payloads are always stored in full.
REVISIT_BYTES = 1000
#: Index lines of a compressed block.
BLOCK_LINES = 1000
#: Record ranges that lie so near each other are read at once, up to the second number of bytes.
GAP_BYTES, READ_BYTES = 4096, 4_000_000

_IDS = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")


def url_key(url: Column) -> Column:
    """The host's labels reversed and joined by commas, ``)``, then path and query; the text itself if it has no host."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, "://([^/?#]*)", 1), UPPER, UPPER.lower())
    rest = F.regexp_extract(text, "://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), ","), F.lit(")"), rest)).otherwise(text)


class Target(NamedTuple):
    store: fs.FileSystem
    path: str


@lru_cache(maxsize=64)
def target(uri: str) -> Target:
    return Target(*fs.FileSystem.from_uri(uri))


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response with its payload or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else _clean(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Refers-To": record_id(refers_to, digest) if revisit else None,
        "X-Page-Id": None if page_id is None else str(page_id),
        "X-Refers-To-Page-Id": str(refers_to) if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Reads a record back and checks its lengths and, for a response, the payload's digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or (not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest)):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return {
        "url": fields.get("WARC-Target-URI"),
        "page_id": int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields["X-Refers-To-Page-Id"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes every row as a record and returns the captures: ``key``, ``page_id``, ``file``, ``offset``, ``length``.

    Of rows with equal payloads of at least ``REVISIT_BYTES`` those with the largest id are responses,
    the others revisit them (a null id is smaller than any; if all ids are null, all are responses).
    A null page has an empty payload. Repeated rows become a record each. The captures are a table in
    the shared folder, so nothing is written twice however often they are read.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    rows = only(pages, id=id_col, url=url_col, html=html_col).select(F.col("id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), filled(F.col("html")).alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    large = F.octet_length("html") >= REVISIT_BYTES
    copies = (
        rows.where(large)
        .groupBy(digest.alias("digest"))
        .agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("last").isNotNull())
        .select("digest", "last")
    )
    # small payloads share few digests and are never revisited: their rows spread by id and url instead
    meets = F.when(large, digest).otherwise(F.concat(F.lit("small "), F.xxhash64("id", "url").cast("string")))
    typed = rows.withColumn("digest", digest).withColumn("meets", meets).join(copies.withColumnRenamed("digest", "meets"), "meets", "left")
    typed = typed.select("id", "url", url_key(F.col("url")).alias("key"), "html", "digest", "last", (F.col("last").isNotNull() & F.coalesce(F.col("id") < F.col("last"), F.lit(True))).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}.warc.gz"
        sink, at = None, 0
        for slab in by_slabs(batches, "html"):
            if sink is None:
                store, path = target(folder)
                store.create_dir(path, recursive=True)
                sink = target(name).store.open_output_stream(target(name).path, compression=None)
            offsets, lengths = [], []
            for row in slab.to_pylist():
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = record(row["id"], row["url"], row["html"].encode(), row["digest"], row["last"], row["revisit"])
                member = pack.compress(raw) + pack.flush()
                sink.write(member)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [slab.column("key"), slab.column("id"), pa.array([name] * slab.num_rows, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                ["key", "page_id", "file", "offset", "length"],
            )
        if sink is not None:
            sink.close()

    return written(typed.mapInArrow(write, "key string, page_id long, file string, offset long, length long"), "captures")


def _order(key: str, page_id: int | None) -> tuple:
    return key, page_id is not None, page_id or 0


def build_index(captures: DataFrame, folder: str | None = None) -> DataFrame:
    """The parts of the capture index, one row for each range of keys: ``file``, ``directory``, ``blocks``, ``first_key``, ``first_id``.

    A part's file holds its blocks end to end; its directory file lists the first entry, offset and
    length of each block. No captures give no parts.
    """
    folder = folder or new_path(captures.sparkSession, "cdx")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = (row for batch in batches for row in batch.to_pylist())
        first = next(entries, None)
        if first is None:
            return
        store, path = target(folder)
        store.create_dir(path, recursive=True)
        name = f"{folder}/{uuid.uuid4().hex}"
        directory, at, block = [], 0, [first]
        with store.open_output_stream(target(f"{name}.cdx").path, compression=None) as sink:
            while block:
                for row in entries:
                    block.append(row)
                    if len(block) == BLOCK_LINES:
                        break
                lines = "\n".join(json.dumps([r["key"], r["page_id"], r["file"], r["offset"], r["length"]]) for r in block)
                data = zlib.compress(lines.encode())
                directory.append(json.dumps([block[0]["key"], block[0]["page_id"], at, len(data)]))
                sink.write(data)
                at += len(data)
                block = [row] if (row := next(entries, None)) else []
        with store.open_output_stream(target(f"{name}.idx").path, compression=None) as sink:
            sink.write("\n".join(directory).encode())
        yield pa.RecordBatch.from_pylist(
            [{"file": f"{name}.cdx", "directory": f"{name}.idx", "blocks": len(directory), "first_key": first["key"], "first_id": first["page_id"]}],
            pa.schema([("file", pa.string()), ("directory", pa.string()), ("blocks", pa.int64()), ("first_key", pa.string()), ("first_id", pa.int64())]),
        )

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    return written(ordered.mapInArrow(pack, "file string, directory string, blocks long, first_key string, first_id long"), "cdx-parts")


class Index:
    """Binary search over parts, directories and blocks; keeps a few directories and blocks at hand."""

    def __init__(self, parts: list[tuple[str, str, str, int | None]]) -> None:
        self.parts = sorted((_order(key, page_id), file, directory) for file, directory, key, page_id in parts)
        self.firsts = [p[0] for p in self.parts]
        self.directory = lru_cache(maxsize=2)(self._directory)
        self.block = lru_cache(maxsize=4)(self._block)

    def _directory(self, part: int) -> tuple[list[tuple], list[tuple[int, int]]]:
        store, path = target(self.parts[part][2])
        with store.open_input_stream(path, compression=None) as f:
            rows = [json.loads(line) for line in f.read().decode().split("\n")]
        return [_order(r[0], r[1]) for r in rows], [(r[2], r[3]) for r in rows]

    def _block(self, part: int, block: int) -> tuple[list[tuple], list[tuple[str, int, int]]]:
        at, size = self.directory(part)[1][block]
        store, path = target(self.parts[part][1])
        with store.open_input_file(path) as f:
            data = f.read_at(size, at)
        rows = [json.loads(line) for line in zlib.decompress(data).decode().split("\n")]
        return [_order(r[0], r[1]) for r in rows], [tuple(r[2:]) for r in rows]

    def find(self, key: str, page_id: int | None) -> Iterator[tuple[str, int, int]]:
        """Where the records of a capture lie; several if its row was repeated."""
        want = _order(key, page_id)
        part = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while part < len(self.parts) and self.firsts[part] <= want:
            firsts, _ = self.directory(part)
            block = max(0, bisect.bisect_left(firsts, want) - 1)
            while block < len(firsts) and firsts[block] <= want:
                keys, places = self.block(part, block)
                for i in range(bisect.bisect_left(keys, want), bisect.bisect_right(keys, want)):
                    yield places[i]
                block += 1
            part += 1


def read_ranges(places: Iterable[tuple[str, int, int]]) -> Iterator[bytes]:
    """The records at the given places, by few reads: near ranges of a file are read together."""
    held: list[tuple[int, int]] = []
    name = None

    def fetch() -> Iterator[bytes]:
        if held:
            store, path = target(name)
            with store.open_input_file(path) as f:
                data = f.read_at(held[-1][0] + held[-1][1] - held[0][0], held[0][0])
            for at, size in held:
                yield zlib.decompress(data[at - held[0][0] :][:size], 31)

    for file, at, size in sorted(places):
        if held and (file != name or at > held[-1][0] + held[-1][1] + GAP_BYTES or at + size - held[0][0] > READ_BYTES):
            yield from fetch()
            held.clear()
        name = file
        held.append((at, size))
    yield from fetch()


def lookup(parts: DataFrame, keys: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the captures in ``keys`` (``key``, ``page_id``), read from the archives by way of the index.

    A capture asked for several times is read once; one that the index lacks gives no row. The parts
    come to the driver: one short row for each partition of the index, whatever the number of captures.
    """
    known = [tuple(r) for r in parts.select("file", "directory", "first_key", "first_id").collect()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last = Index(known), None
        fields = [("url", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
        schema = pa.schema(fields if with_payload else fields[:-1])
        for batch in batches:
            places = []
            for key, page_id in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                if (key, page_id) != last:
                    places += index.find(key, page_id)
                    last = (key, page_id)
            held, size = [], 0
            for raw in read_ranges(places):
                held.append({k: v for k, v in parse_record(raw).items() if with_payload or k != "payload"})
                size += len(raw) * with_payload
                if size > READ_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

    ordered = keys.select("key", F.col("page_id").cast("long").alias("page_id")).repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    kind = "url string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return ordered.mapInArrow(read, kind)
