"""WARC archives with a two-level capture index (operator 5).

Records are range-partitioned and sorted by (reversed-host URL key, page id); each task writes one archive (a gzip
member for each record), one index file (sorted entries in compressed blocks) and one sparse directory (the first key
of each block and where it lies) to the folder that all executors share. A look-up finds the archive whose key range
holds the key, binary-searches its directory, reads one index block and then only the record's byte range. Keys to be
looked up are dealt by range too, so a task meets few archives, and neighbouring keys find their block read already.

Of equal payloads one record is the response and the others are revisits of it. That is decided on digests alone:
payloads are shuffled once, to their place in the order, where each meets its own digest's verdict. A hot host, URL or
payload is split by page id.

A retried task writes files of its own name; only those that its result names are read. Cases: null html is an empty
payload; a null or odd URL has its text as key; rows that repeat a page id are records of their own (all responses, if
theirs is the response's id); a null page id is below all others; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotforge.llm import textops

ARCHIVE = "stem string, first_key string, first_page long, last_key string, n_records long, n_blocks long, n_bytes long"
_RECORD = "page_id long, url string, url_key string, record_type string, payload_bytes long, payload_digest string, refers_to long"
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]+)?([^#]*)"


def url_key(url):
    """``http://a.b.org/x?q`` as ``org,b,a)/x?q``."""
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, _URL, 1)), r"\.")), ",")
    return F.when(url.rlike(_URL), F.concat(host, F.lit(")"), F.regexp_extract(url, _URL, 2))).otherwise(F.coalesce(url, F.lit("")))


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value) -> str:
    return "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in str(value if value is not None else ""))


def _record(kind: str, page_id, url, sha: bytes, date: str, more: list[str], block: bytes) -> bytes:
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}", "Content-Type: application/http; msgtype=response", *more,
    ]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def record(page_id, url, payload: bytes, date: str) -> bytes:
    """A response record."""
    return _record("response", page_id, url, hashlib.sha1(payload).digest(), date, [], _http(len(payload)) + payload)


def revisit(page_id, url, sha: bytes, length: int, refers_to, date: str) -> bytes:
    """A revisit record: the HTTP header, with the payload's length, and no payload."""
    more = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return _record("revisit", page_id, url, sha, date, more, _http(length))


def parse(raw: bytes) -> dict:
    """The record's fields; a response's payload must have the length and digest that its headers give."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(http.decode().rpartition("Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = lambda name: int(x) if (x := fields[name][len("<urn:page:") : -1]) != "None" else None
    if fields["WARC-Type"] == "response" and (len(payload) != length or _digest(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": length,
        "payload_digest": digest, "refers_to": page("WARC-Refers-To") if "WARC-Refers-To" in fields else None, "payload": payload,
    }


def write(
    pages: DataFrame, folder: str, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
    least_bytes: int = 0, entries: int = 64, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write all pages; one row for each archive: where it is, its first key, and how much it holds."""
    rows = textops.keyed(pages, {"page_id": id_column, "url": url_column, "html": html_column}).select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html")
    )
    rows = rows.select("page_id", "url", url_key(F.col("url")).alias("url_key"), "html", F.unhex(F.sha1("html")).alias("sha"), F.octet_length("html").cast("long").alias("size"))
    digests = rows.select("url_key", "page_id", "sha", "size").distinct()
    first = digests.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("first"))
    other = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    # where a payload's verdict and the payload itself are sorted together, the verdict comes first
    marks = digests.join(first, ["sha", "size"], "left").select("url_key", "page_id", "sha", F.lit(0).alias("part"), other.alias("refers_to"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"))
    payloads = rows.select("url_key", "page_id", "sha", F.lit(1).alias("part"), F.lit(None).cast("long").alias("refers_to"), "url", "html")
    placed = marks.union(payloads).repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id", "sha", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        fs, path = _open(stem)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        directory, block, n, refers_to, last_key = [], [], 0, None, None
        at = index_at = 0
        with fs.open_output_stream(f"{path}.warc.gz", compression=None) as out, fs.open_output_stream(f"{path}.idx", compression=None) as index:

            def close_block() -> None:
                nonlocal index_at
                packed = zlib.compress("".join(f"{json.dumps(e)}\n" for e in block).encode())
                directory.append((*block[0][:2], index_at, len(packed)))
                index.write(packed)
                index_at += len(packed)
                block.clear()

            for batch in batches:
                for part in textops.slices(batch, 6):
                    for row in part.to_pylist():
                        if row["part"] == 0:
                            refers_to = row["refers_to"]
                            continue
                        page, url, payload = row["page_id"], row["url"], row["html"]
                        raw = record(page, url, payload, date) if refers_to is None else revisit(page, url, row["sha"], len(payload), refers_to, date)
                        packed = gzip.compress(raw, 6, mtime=0)
                        out.write(packed)
                        block.append((row["url_key"], page, at, len(packed)))
                        at += len(packed)
                        n, last_key = n + 1, row["url_key"]
                        if len(block) == entries:
                            close_block()
            if block:
                close_block()
        with fs.open_output_stream(f"{path}.dir", compression=None) as out:
            out.write(json.dumps(directory).encode())
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([stem]), pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([last_key]), pa.array([n]), pa.array([len(directory)]), pa.array([at + index_at])],
                ["stem", "first_key", "first_page", "last_key", "n_records", "n_blocks", "n_bytes"],
            )

    return textops.cut(placed.mapInArrow(textops.releasing(run), ARCHIVE))


def _place(key: str, page) -> tuple:
    """Spark's order of (key, page id): a null id is below all others."""
    return (key, page is not None, page or 0)


class Archive:
    """One archive, opened for look-ups; keeps the index block that was read last."""

    def __init__(self, stem: str):
        fs, path = _open(stem)
        with fs.open_input_file(f"{path}.dir") as f:
            self.directory = json.loads(f.read())
        self.firsts = [_place(*d[:2]) for d in self.directory]
        self.index, self.warc = fs.open_input_file(f"{path}.idx"), fs.open_input_file(f"{path}.warc.gz")
        self.number, self.block, self.places = None, [], []

    def _load(self, number: int) -> None:
        if number != self.number:
            self.index.seek(self.directory[number][2])
            self.block = [json.loads(x) for x in zlib.decompress(self.index.read(self.directory[number][3])).decode().splitlines()]
            self.places, self.number = [_place(*e[:2]) for e in self.block], number

    def find(self, low: tuple, high: tuple) -> Iterator[dict]:
        """The records from the place low up to high, included."""
        number = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while number < len(self.firsts) and self.firsts[number] <= high:
            self._load(number)
            for key, _, at, length in self.block[bisect.bisect_left(self.places, low) : bisect.bisect_right(self.places, high)]:
                self.warc.seek(at)
                yield parse(gzip.decompress(self.warc.read(length))) | {"url_key": key}
            number += 1

    def every(self) -> Iterator[dict]:
        for number in range(len(self.directory)):
            self._load(number)
            for key, _, at, length in self.block:
                self.warc.seek(at)
                yield parse(gzip.decompress(self.warc.read(length))) | {"url_key": key}

    def close(self) -> None:
        self.index.close()
        self.warc.close()


def _rows(found: list[dict]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _RECORD.split(", ")]
    kinds = [pa.string() if "string" in c else pa.int64() for c in _RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)], names)


def read(archives: DataFrame) -> DataFrame:
    """Every record, archive by archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem in batch.column(0).to_pylist():
                archive, found = Archive(stem), []
                for r in archive.every():
                    found.append({k: v for k, v in r.items() if k != "payload"})
                    if len(found) == 1000:
                        yield _rows(found)
                        found = []
                archive.close()
                yield _rows(found)

    # explicitly so many parts: their rows are small, what they read is not
    return archives.select("stem").repartition(max(1, archives.count()), "stem").mapInArrow(textops.releasing(run), _RECORD)


def lookup(archives: DataFrame, asked: DataFrame, *, url_column: str = "url", id_column: str | None = None, task_bytes: int = 16 << 20) -> DataFrame:
    """The records of the given URLs (compared by key), or of the given URLs and page ids.

    Only the index blocks and byte ranges that hold them are read. ``task_bytes`` of archives make a task's share.
    """
    key = url_key(F.col(f"`{url_column}`")).alias("key")
    keys = asked.select(key, F.col(f"`{id_column}`").cast("long").alias("page") if id_column else F.lit(None).cast("long").alias("page")).distinct()
    # one row for each archive, as many as the write had tasks
    listed = sorted(((_place(r["first_key"], r["first_page"]), r["stem"], r["n_bytes"]) for r in archives.collect()), key=lambda a: a[0])
    shared = archives.sparkSession.sparkContext.broadcast([a[:2] for a in listed])
    tasks = max(archives.sparkSession.sparkContext.defaultParallelism, -(-sum(a[2] for a in listed) // task_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, stems = [a[0] for a in shared.value], [a[1] for a in shared.value]
        number, archive, found = None, None, []

        for batch in batches:
            for key, page in zip(*[batch.column(i).to_pylist() for i in range(2)], strict=True):
                low, high = (_place(key, page),) * 2 if id_column else ((key, False, 0), (key, True, 1 << 63))
                at = max(0, bisect.bisect_left(firsts, low) - 1)
                while at < len(firsts) and firsts[at] <= high:
                    if at != number:
                        if archive:
                            archive.close()
                        number, archive = at, Archive(stems[at])
                    for r in archive.find(low, high):
                        found.append({k: v for k, v in r.items() if k != "payload"})
                        if len(found) == 1000:
                            yield _rows(found)
                            found = []
                    at += 1
        if archive:
            archive.close()
        yield _rows(found)

    # explicitly so many parts: their rows are small, what they read is not
    return keys.repartitionByRange(tasks, "key", "page").sortWithinPartitions("key", "page").mapInArrow(textops.releasing(run), _RECORD)


def new_folder(spark) -> str:
    return f"{textops.shared_folder(spark)}/slotforge-warc-{uuid.uuid4().hex}"
