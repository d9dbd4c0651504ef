"""Vectorised word and window hashing over Arrow string columns.

A batch's texts stay in their Arrow buffer; words are found as byte ranges and hashed with numpy, so no
Python object is made per word. A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WHITE = b" \t\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64
_BYTES_U = np.arange(1, 257, dtype=np.uint64)
_LOWER_U = _BYTES_U[_LOWER]
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
#: Byte weights inside a word, for each block of so many bytes; longer words weigh each block by its number as well.
_POW = np.cumprod(np.full(1 << 12, _BASE, dtype=np.uint64))
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string or binary column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about ``most`` bytes of text each; one long text is one part."""
    _, at = buffers(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


class Words:
    """Words of the texts of one column: byte ranges, 64-bit hashes and the number in each row.

    ``space`` tells for each byte whether it is outside words.
    """

    def __init__(self, column: pa.Array, lower: bool = False, hashed: bool = True, space: np.ndarray = SPACE):
        self.data, self.rows = buffers(column)
        self.solid = solid = ~space[self.data]
        size = len(self.data)
        opens, closes = solid.copy(), solid.copy()
        if size:
            cut = self.rows[1:-1]
            cut = cut[(cut > 0) & (cut < size)]
            keep = np.ones(size, dtype=bool)
            keep[cut] = False  # a word does not go on into the next row
            opens[1:] &= ~(solid[:-1] & keep[1:])
            closes[:-1] &= ~(solid[1:] & keep[1:])
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.bounds = np.searchsorted(self.starts, self.rows)
        self.counts = np.diff(self.bounds)
        self.hashes = self._hash(lower) if hashed else None

    def _hash(self, lower: bool, most: int = 1 << 18) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        first = 0
        while first < len(out):
            last = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + most, "right")))
            starts, lens = self.starts[first:last], (self.ends - self.starts)[first:last]
            begin = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
            inside = np.arange(begin[-1], dtype=np.int32)
            inside -= np.repeat(begin[:-1], lens)
            part = slice(starts[0], self.ends[last - 1])
            raw = self.data[part][self.solid[part]]
            value = _POW[inside & np.int32(len(_POW) - 1)]
            value *= (_LOWER_U if lower else _BYTES_U)[raw]
            if lens.max() > len(_POW):
                block = inside // np.int32(len(_POW))
                value *= np.where(block > 0, mix(block.astype(np.uint64) + _STEP) | _U(1), _U(1))
            out[first:last] = mix(np.add.reduceat(value, begin[:-1]) + lens.astype(np.uint64) * _STEP)
            first = last
        return out

    def left(self) -> np.ndarray:
        """For each word, the words from it to its row's end, itself included."""
        return np.repeat(self.bounds[1:], self.counts) - np.arange(len(self.starts))

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def text(self, first: int, last: int) -> bytes:
        """Words first to last, joined by one space."""
        return b" ".join(bytes(self.data[self.starts[first] : self.ends[last - 1]]).split()) if last > first else b""


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash (mod 2^64) of every ``width`` consecutive values, by doubling; entry i starts at i."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    out, have, power, block, span = None, 0, _STEP, values, 1
    left = width
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out, have, scale = block, span, power
                else:
                    room = min(len(out), len(block) - have)
                    out = out[:room] + scale * block[have : have + room]
                    have, scale = have + span, scale * power
            left >>= 1
            if left:
                block = block[:-span] + power * block[span:]
                power, span = power * power, span * 2
    return mix(out[: len(values) - width + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    block, span = values, 1
    while span * 2 <= width:
        block = np.minimum(block[:-span], block[span:])
        span *= 2
    rest = width - span
    return np.minimum(block[: len(block) - rest], block[rest:]) if rest else block


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local session may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or "/tmp/checkpoints").rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again.

    Later reads do not run its plan a second time, and survive lost executors.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/slotforge-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


class IdBits:
    """A bitmap of hashes of ids, broadcast: it tells which ids are surely not among the given ones.

    It has ``each`` bits for an id and at most ``most`` bits (32 MB) in all; where ids outgrow that it tells less, so what
    follows must be exact without it.
    """

    def __init__(self, ids: DataFrame, most: int = 1 << 28, each: int = 16):
        spark, column = ids.sparkSession, ids.columns[0]
        self.size = 1 << 20
        while self.size < min(most, each * ids.count()):
            self.size *= 2
        slot = self.slot(F.col(f"`{column}`"))
        marked = ids.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).toArrow()
        bits = np.zeros((self.size // 32768, 4096), np.uint8)
        for bucket, own in zip(marked.column(0).to_pylist(), marked.column(1), strict=True):  # most / 32768 rows of 4 KB at most
            bits[bucket - 1] = np.frombuffer(own.as_buffer(), np.uint8)
        self.shared = spark.sparkContext.broadcast(bits.ravel())

    def slot(self, ids: Column) -> Column:
        return F.pmod(F.xxhash64(ids.cast("long")), F.lit(self.size)) + 1

    def has(self, slot: np.ndarray) -> np.ndarray:
        at = slot - 1
        return (self.shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def among(self, ids: Column) -> Column:
        """False for ids that are surely not among the given ones, and for null ids."""
        bits = self

        @F.pandas_udf("boolean")
        def doubtful(slot):
            return slot.notna() & bits.has(slot.fillna(1).to_numpy(np.int64))

        return doubtful(F.when(ids.isNotNull(), self.slot(ids)))


def free_name(frame: DataFrame) -> str:
    """A name that none of the frame's columns has."""
    return "_" * (1 + max(map(len, frame.columns)))


def without_ids(frame: DataFrame, id_column: str, gone: DataFrame) -> DataFrame:
    """The rows whose id is not in the one column of ``gone``; rows with a null id stay.

    Only rows that the bitmap cannot clear are shuffled to an exact join; the others pass where they lie.
    """
    name = free_name(frame)
    gone = cut(gone.toDF(name).where(F.col(name).isNotNull()).distinct())
    bits, own = IdBits(gone), F.col(f"`{id_column}`")
    passed, doubtful = frame.where(~bits.among(own)), frame.where(bits.among(own))
    return passed.unionByName(doubtful.join(gone, own.cast("long") == F.col(name), "left_anti"))


def releasing(run):
    """The function over batches, after which the worker gives freed memory back to the system.

    Workers are kept for the next tasks, and else would hold what their largest task took.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound of an Arrow batch to ``BATCH_BYTES``, unless it is lower already.

    A batch is held several times over, in the executor and in the worker, and texts are long: with the default of
    64 MB two tasks' copies would fill an executor.
    """
    now = re.fullmatch(r"(\d+)([bkm]?)b?", spark.conf.get(_BATCH).lower())
    if not now or int(now[1]) * {"k": 1 << 10, "m": 1 << 20}.get(now[2], 1) > BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def keyed(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, under this operator's own names: others cannot clash. Bounds batches as well."""
    bound_batches(frame.sparkSession)
    return frame.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])

