"""Removal of repeated word windows (operator 4): Rabin-Karp hashes of every window of a fixed number of words.

A window goes where its word sequence also starts in a document with a smaller id; the words that such windows cover
are removed. Every window is hashed, but only those that can repeat are counted one by one. Each window is
represented by its anchor, the least hash of its half-length windows: equal windows have equal anchors, and an anchor
stands for a block of neighbouring windows. Blocks are counted by anchor in Spark; an anchor of one document only is
done with. Where all blocks of an anchor are alike, the block's smallest document keeps it. The windows of the other
anchors are counted one by one, keyed by anchor and window hash, 128 bits in all. Counts are pre-aggregated, and
a passage that a third of all documents share is one row for each task. Only texts that have such anchors are shuffled,
once, to meet them; a row is named by its id and a hash of its text, so a list of anchors is that of one text.

Cases: of documents with the same window the one with the smallest id keeps it; null, empty and short texts have no windows; windows repeated inside one document stay; rows with equal ids
are one document (same results if the texts are equal); rows with a null id neither lose words nor take them from
others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotforge.llm import textops
from slotforge.llm.textops import Words, mix, rolling, sliding_min


class Windows:
    """Windows, anchors and blocks of the texts of one batch."""

    def __init__(self, column: pa.Array, width: int):
        self.words = Words(column)
        half = max(1, width // 2)
        w = rolling(self.words.hashes, width)
        whole = self.words.left()[: len(w)] >= width
        self.at = np.flatnonzero(whole)  # first words of windows
        self.row = self.words.row()[self.at]
        self.hashes = w[self.at]
        self.anchors = sliding_min(rolling(self.words.hashes, half), width - half + 1)[self.at]
        new = np.ones(len(self.at), bool)
        if len(new):
            new[1:] = (self.row[1:] != self.row[:-1]) | (self.anchors[1:] != self.anchors[:-1]) | (np.diff(self.at) != 1)
        self.blocks = np.flatnonzero(new)

    def block_hashes(self) -> np.ndarray:
        if not len(self.blocks):
            return np.zeros(0, np.uint64)
        inside = np.arange(len(self.at)) - np.repeat(self.blocks, np.diff(np.append(self.blocks, len(self.at))))
        return mix(np.add.reduceat(mix(self.hashes + inside.astype(np.uint64)), self.blocks))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def remove_repeats(docs: DataFrame, width: int = 50, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Words of each document before and after removal, and the digest of those kept."""
    docs = textops.keyed(docs, {"doc_id": id_column, "text": text_column}).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("rid"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, 1):
                w = Windows(part.column(1), width)
                rows = w.row[w.blocks]
                yield _batch(
                    anchor=w.anchors[w.blocks].view(np.int64), doc_id=part.column(0).to_numpy()[rows], rid=part.column(2).to_numpy()[rows], block=w.block_hashes().view(np.int64)
                )

    found = textops.cut(known.mapInArrow(textops.releasing(blocks), "anchor long, doc_id long, rid long, block long"))
    shared = (
        found.groupBy("anchor")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("block").alias("a"), F.max("block").alias("b"))
        .where("first < last")
        .select("anchor", "first", (F.col("a") != F.col("b")).alias("mixed"))
    )
    of_docs = textops.cut(
        found.select("anchor", "doc_id", "rid")
        .distinct()
        .join(shared, "anchor")
        .where("mixed OR doc_id > first")
        .groupBy("doc_id", "rid")
        .agg(
            F.collect_list(F.when(F.col("mixed"), F.col("anchor"))).alias("mixed"),
            F.collect_list(F.when(~F.col("mixed"), F.col("anchor"))).alias("alike"),
        )
    )
    likely = known.where(textops.IdBits(of_docs.select("doc_id")).among(F.col("doc_id")))
    touched = textops.cut(likely.join(of_docs, ["doc_id", "rid"]))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, 2):
                w = Windows(part.column(2), width)
                bounds = np.searchsorted(w.row, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    here = slice(bounds[i], bounds[i + 1])
                    open_ = np.isin(w.anchors[here].view(np.int64), np.array(part.column(3)[i].as_py(), np.int64))
                    hashes, at = np.unique(w.hashes[here][open_], return_index=True)
                    own = [np.full(len(at), part.column(k)[i].as_py(), np.int64) for k in (0, 1)]
                    yield _batch(anchor=w.anchors[here][open_][at].view(np.int64), hash=hashes.view(np.int64), doc_id=own[0], rid=own[1])

    counted = touched.where("size(mixed) > 0").select("doc_id", "rid", "text", "mixed").mapInArrow(textops.releasing(keys), "anchor long, hash long, doc_id long, rid long")
    firsts = counted.groupBy("anchor", "hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    repeats = (
        counted.join(firsts.select("anchor", "hash", "first"), ["anchor", "hash"])
        .where("doc_id > first")
        .groupBy("doc_id", "rid")
        .agg(F.collect_set("hash").alias("hashes"))  # at most the windows of one text
    )

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, 1):
                w = Windows(part.column(1), width)
                words, n = w.words, len(w.words.starts)
                alike = np.zeros(len(w.at), bool)
                bounds = np.searchsorted(w.row, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    here = slice(bounds[i], bounds[i + 1])
                    alike[here] = np.isin(w.anchors[here].view(np.int64), np.array(part.column(2)[i].as_py() or [], np.int64))
                    if listed := part.column(3)[i].as_py():
                        alike[here] |= np.isin(w.hashes[here].view(np.int64), np.array(listed, np.int64))
                # maximal intervals: +1 where a removed window starts, -1 after it ends
                turn = np.zeros(n + 1, np.int64)
                np.add.at(turn, w.at[alike], 1)
                np.add.at(turn, w.at[alike] + width, -1)
                gone = np.cumsum(turn)[:n] > 0
                full, left = [], []
                for i in range(part.num_rows):
                    a, b = words.bounds[i], words.bounds[i + 1]
                    text = words.text(a, b)
                    full.append(hashlib.sha256(text).hexdigest())
                    left.append(hashlib.sha256(b" ".join([x for x, g in zip(text.split(), gone[a:b].tolist(), strict=True) if not g])).hexdigest())
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.bounds[:-1]) * (words.counts > 0) if part.num_rows else []
                yield _batch(doc_id=part.column(0), full=full, n_removed=removed, kept_sha256=left)

    changed = (
        touched.join(repeats, ["doc_id", "rid"], "left")
        .where("size(alike) > 0 OR hashes IS NOT NULL")
        .select("doc_id", "text", "alike", "hashes")
        .mapInArrow(textops.releasing(kept), "doc_id long, full string, n_removed long, kept_sha256 string")
        .distinct()
    )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, 1):
                words = Words(part.column(1), hashed=False)
                full = [hashlib.sha256(words.text(a, b)).hexdigest() for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
                yield _batch(doc_id=part.column(0), n_words=words.counts, full=full)

    every = docs.mapInArrow(textops.releasing(whole), "doc_id long, n_words long, full string")
    return every.join(changed, ["doc_id", "full"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "full").alias("kept_sha256")
    )
