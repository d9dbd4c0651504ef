"""Sequence packing by Karmarkar-Karp multiway differencing (operator 1).

Each document's ids (with an end id) are cut at the capacity: whole cuts fill a sequence alone. The rests, in pieces
of at most ``rest_piece`` ids, are dealt, a few hundred at a time, into near-equal windows; tiny ones are joined into
bundles first, and a group is dealt only when its ids fill many windows. Differencing
keeps a heap of partial partitions and merges the two that are most uneven with their loads opposed; the number of
windows rises while the fullest one is above capacity. A task holds one such group at most; nothing is shuffled, so one hot source or key makes no
difference, and a lost executor only has its own partitions packed again, to the same result.

Cases: null or empty text is the end id alone; repeated rows and null ids are packed as rows of their own; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import contextlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from slotforge.llm import textops

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tokenizer:
    """Ids of a ``tokenizers`` file as little-endian 32-bit bytes.

    With ``ranks_path``, the same byte-level vocabulary as ranks, texts of Latin-1 characters without an added token's
    string go to ``tiktoken``, which gives the same ids several times faster; the libraries may class newer characters differently.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer as Base

        self.base, self.fast = Base.from_file(path), None
        # their strings in a text are single ids, which the ranks do not have
        self.added = [t.content for t in self.base.get_added_tokens_decoder().values()]
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast and not any(t in text for t in self.added):
            with contextlib.suppress(UnicodeEncodeError):
                text.encode("latin-1")
                return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.base.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the indices of ``sizes`` dealt into so many near-equal windows."""
    heap, groups = [], {}
    for i, size in enumerate(sizes):
        loads, nodes = np.zeros(windows, np.int64), np.full(windows, -1)
        loads[0], nodes[0] = size, i
        heap.append((-size, i, loads, nodes))
    heapq.heapify(heap)
    fresh = len(sizes)
    while len(heap) > 1:
        _, _, a, inside_a = heapq.heappop(heap)
        _, _, b, inside_b = heapq.heappop(heap)
        loads, other, nodes = a + b[::-1], inside_b[::-1], np.where(inside_a < 0, inside_b[::-1], inside_a)
        for k in np.flatnonzero((inside_a >= 0) & (other >= 0)):
            groups[fresh] = (int(inside_a[k]), int(other[k]))
            nodes[k] = fresh
            fresh += 1
        order = np.argsort(-loads, kind="stable")
        loads, nodes = loads[order], nodes[order]
        heapq.heappush(heap, (int(loads[-1] - loads[0]), fresh, loads, nodes))
        fresh += 1

    def members(node: int) -> list[int]:
        found, todo = [], [node] if node >= 0 else []
        while todo:
            n = todo.pop()
            todo += groups[n] if n in groups else ()
            found += [] if n in groups else [n]
        return sorted(found)

    return [members(int(n)) for n in heap[0][3]] if heap else []


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """The least number of differenced windows, counted up from the total, of which none is above capacity."""
    count = -(-sum(sizes) // capacity)
    while True:
        found = difference(sizes, count)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        count += 1


def pack(
    docs: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text",
    ranks_path: str | None = None, capacity: int = 2048, end_id: int = 1, rest_piece: int = 512, group: int = 256, fill: int = 32,
) -> DataFrame:
    """One row for each piece of each document: where it lies in its document and in its sequence.

    ``sequence_id`` is unique over the table: it holds the partition number and a count in the partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Tokenizer(tokenizer_path, ranks_path)
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        bundles: list[list[tuple]] = []
        sizes: list[int] = []
        whole, width = 4 * capacity, 4 * rest_piece

        def deal() -> list[tuple]:
            nonlocal sequence
            out = []
            for window in windows_of(sizes, capacity):
                at = 0
                for i in window:
                    for row in bundles[i]:
                        out.append((*row, sequence, at))
                        at += row[2]
                sequence += 1
            bundles.clear()
            sizes.clear()
            return out

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = zip(*pieces, strict=True) if pieces else [[]] * 7
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            for part in textops.slices(batch, 1, 1 << 20):
                out = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    total = len(ids) // 4
                    at = 0
                    while at < len(ids):
                        piece = ids[at : at + (whole if len(ids) - at >= whole else width)]
                        row = (doc, at // 4, len(piece) // 4, zlib.crc32(piece), total)
                        at += len(piece)
                        if len(piece) == whole:
                            out.append((*row, sequence, 0))
                            sequence += 1
                        elif sizes and sizes[-1] + row[2] <= rest_piece // 2:
                            bundles[-1].append(row)
                            sizes[-1] += row[2]
                        else:
                            bundles.append([row])
                            sizes.append(row[2])
                    if len(sizes) >= group and sum(sizes) >= fill * capacity:
                        out += deal()
                yield rows(out)
        yield rows(deal())

    return textops.keyed(docs, {"doc_id": id_column, "text": text_column}).mapInArrow(textops.releasing(run), SCHEMA)
