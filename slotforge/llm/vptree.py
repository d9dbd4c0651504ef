"""SimHash near-duplicates by vantage-point trees (operator 12).

A text's fingerprint has a bit set where over half of its shingles' XXH64 (seed 42) have it; shingles are three words,
repeats included. Two texts link at three or fewer differing bits; links make components, named by their smallest id.

Documents with equal fingerprints are one node. A tree of vantage points is fitted on a bounded sample of fingerprints
(about ``SAMPLE``, those with the least hashes): each inner node splits by the Hamming distance to its vantage at the median,
and its leaves are the shards. Every fingerprint has one home shard. By the triangle inequality a fingerprint within
three bits of one inside a radius is at most three farther from the vantage, so a fingerprint is also sent, as a query,
to the shards that its distance to a radius leaves possible; each pair's later shard asks the earlier one. So all
links are found, whatever the sample.

No group is expanded into pairs. A shard's homes are dealt to parts of ``PART`` rows; first each part links what is in
it and those links are joined to components, then rows of different components only are compared: parts of one shard
with each other (the largest component's parts need not meet each other), and queries with the parts of the shards
they are sent to, each task going on with a tree of its own. A task reports a link only where it joins what was apart
in it. A dense family of near copies
(thousands within a few bits) is mostly joined in the first step and has little to compare in the second.

Work grows with a power of about 1.65 of the number of different fingerprints, as three bits of 64 leave a query about
four fifths of the shards at each split; memory of a task is bounded by the parts.

Cases: A-Z count as lower case; a text with fewer words than a shingle is one shingle; null texts and texts without
words have fingerprint zero, which links like any other; rows with equal ids are one node (its links are those of all
its rows), each row with its own fingerprint; a null id has a null component and links nothing; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotforge.llm import textops
from slotforge.llm.neardup import _tiles, connect

_U = np.uint64
BITS, SEED = 64, 42
#: Fingerprints that the tree is fitted on; rows of a part of a shard; queries that meet a part in one task.
SAMPLE, PART, ASKED = 1 << 16, 1 << 15, 1 << 17
BLOCK_BYTES = 1 << 20
_WHITE = re.compile(rb"[ \t-\r]")


def _blocks(text: bytes, width: int) -> Iterator[list[bytes]]:
    """The words of a text in runs that overlap by ``width`` - 1 words."""
    at, carried = 0, []
    while at < len(text):
        end = _WHITE.search(text, at + BLOCK_BYTES)
        end = end.start() if end else len(text)
        words = carried + text[at:end].lower().split()
        at, carried = end, words[len(words) - width + 1 :] if len(words) >= width else words
        if len(words) >= width or at >= len(text):
            yield words


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of a whole text, a block of words at a time."""
    total, ones, digest = 0, np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for words in _blocks(text, width):
        if len(words) < width and (total or not words):
            continue
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
        count = max(len(words) - width + 1, 1)
        first, last = [0, *ends[: count - 1].tolist()], (ends[min(width, len(words)) - 1 :] - 1).tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64).view(np.uint8).reshape(-1, 8)
        for at in range(0, count, 1 << 14):
            ones += np.unpackbits(hashes[at : at + (1 << 14)], axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += count
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > total))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of each row of (doc_id, text); the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = textops.buffers(batch.column(1))
            raw, at = memoryview(data), at.tolist()
            found = np.array([fingerprint(bytes(raw[a:b]), width) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(textops.releasing(run), "doc_id long, fp long")


class Tree:
    """A vantage-point tree: inner node k has children 2k + 1 (within its radius) and 2k + 2; leaves are the shards."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.depth = 0
        while (1 << self.depth) < shards and len(sample) >> (self.depth + 1) >= 8:
            self.depth += 1
        inner = (1 << self.depth) - 1
        self.vantage, self.radius = np.zeros(inner, np.uint64), np.zeros(inner, np.int16)
        groups = {0: sample}
        for k in range(inner):
            own = groups.pop(k)
            self.vantage[k], self.radius[k] = self._split(own)
            near = np.bitwise_count(own ^ self.vantage[k]) <= self.radius[k]
            groups[2 * k + 1], groups[2 * k + 2] = own[near], own[~near]

    @staticmethod
    def _split(own: np.ndarray) -> tuple[int, int]:
        """Of a few candidates, the vantage and radius that leave the fewest sampled fingerprints in reach of both sides."""
        if not len(own):
            return 0, BITS // 2
        best = None
        for v in own[:: max(1, len(own) // 8)][:8]:
            away = np.bitwise_count(own ^ v).astype(np.int16)
            for radius in np.unique(np.quantile(away, (0.4, 0.5, 0.6)).astype(np.int16)):
                inside = int((away <= radius).sum())
                reach = int((np.abs(away - radius) <= 3).sum()) + abs(2 * inside - len(own))
                if best is None or reach < best[0]:
                    best = reach, int(v), int(radius)
        return best[1:]

    def route(self, fps: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home) of each fingerprint's home, and of the earlier shards that it has to ask."""
        rows, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(self.depth):
            away = np.bitwise_count(fps[rows] ^ self.vantage[node]).astype(np.int16) - self.radius[node]
            near, left, right = away <= 0, 2 * node + 1, 2 * node + 2
            # homes go to their side; from the far side they ask the near one; queries go wherever a link may be
            ask = np.where(home, ~near & (away <= within), away <= within)
            far = ~home & (away > -within)
            rows, node, home = (
                np.concatenate((rows[home], rows[ask], rows[far])),
                np.concatenate((np.where(near, left, right)[home], left[ask], right[far])),
                np.concatenate((home[home], np.zeros(int(ask.sum()) + int(far.sum()), bool))),
            )
        return rows, node - ((1 << self.depth) - 1), home


def _reach(left: np.ndarray, right: np.ndarray, within: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in both sets that may be near each other, as pairs of arrays: a vantage-point tree over the left ones, each
    of whose splits sends right ones to the sides that its radius leaves possible. Ends where a split saves little."""
    todo = [(np.arange(len(left)), np.arange(len(right)))]
    while todo:
        a, b = todo.pop()
        if len(a) * len(b) <= most or len(a) < 64:
            yield a, b
            continue
        vantage, radius = Tree._split(left[a[:: max(1, len(a) // 512)]])
        at, to = (np.bitwise_count(x ^ np.uint64(vantage)).astype(np.int16) - radius for x in (left[a], right[b]))
        near, far = (a[at <= 0], b[to <= within]), (a[at > 0], b[to > -within])
        if len(near[0]) * len(near[1]) + len(far[0]) * len(far[1]) > 0.95 * len(a) * len(b):
            yield a, b
        else:
            todo += [near, far]


def joined(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, label_x: np.ndarray, label_y: np.ndarray, within: int) -> tuple[list, list]:
    """Links between two sets of fingerprints with their ids and labels: those that join labels that were apart."""
    names, place = np.unique(np.concatenate((label_x, label_y)), return_inverse=True)
    now, out = np.arange(len(names)), ([], [])
    of_x, of_y = place[: len(x)], place[len(x) :]
    for a, b in _reach(left, right, within):
        block, other = max(1, (1 << 19) // max(1, len(b))), right[b]
        for at in range(0, len(a), block):
            near = np.bitwise_count(left[a[at : at + block], None] ^ other[None, :]) <= within
            for k in np.flatnonzero(near.any(1)):
                hit, row = b[near[k]], a[at + k]
                own = now[of_x[row]]
                hit = hit[now[of_y[hit]] != own]
                if len(hit):
                    groups, one = np.unique(now[of_y[hit]], return_index=True)
                    out[0].extend([int(x[row])] * len(one))
                    out[1].extend(y[hit[one]].tolist())
                    now[np.isin(now, groups)] = own
    return out


def _pairs(x: list, y: list) -> pa.Table:
    return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})


def _meet(tiles: DataFrame, names: list[str], within: int) -> DataFrame:
    """Links (x, y) in each group of (fp, doc_id, component, side): of rows of side 0 with rows of side 1, or of side 2
    with each other as well."""

    def run(table: pa.Table) -> pa.Table:
        fp, ids, label, side = (table.column(c).to_numpy() for c in ("fp", "doc_id", "component", "side"))
        fp, one, other = fp.view(np.uint64), np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        return _pairs(*joined(fp[one], fp[other], ids[one], ids[other], label[one], label[other], within))

    return tiles.select(*names, "fp", "doc_id", "component", "side").groupBy(*names).applyInArrow(run, "x long, y long")


def links(nodes: DataFrame, within: int = 3, *, sample: int = SAMPLE, part: int = PART, asked: int = ASKED) -> DataFrame:
    """Links (x, y) that connect what is within so many bits, from (fp, doc_id) with one row for each fingerprint."""
    spark, count = nodes.sparkSession, nodes.count()
    share = (2**63 - 1) * min(sample, count) // max(count, 1)
    sampled = F.shiftrightunsigned(F.xxhash64("fp"), 1) <= F.lit(share)
    fitted = nodes.where(sampled).select("fp").toArrow().column(0).to_numpy().view(np.uint64)  # about ``sample`` longs at most
    # shards grow with the root of the rows: what is sent grows less than with ever more shards, and the tree goes on in tasks
    shards = max(-(-count // part), math.isqrt(count) // 8)
    tree = spark.sparkContext.broadcast(Tree(np.sort(fitted), shards))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.slice(at, 4096)
                row, shard, home = tree.value.route(own.column(0).to_numpy().view(np.uint64), within)
                yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(row)), own.column(1).take(pa.array(row)), pa.array(shard), pa.array(home)], ["fp", "doc_id", "shard", "home"])

    sent = textops.cut(nodes.select("fp", "doc_id").mapInArrow(deal, "fp long, doc_id long, shard long, home boolean"))
    sizes = textops.cut(sent.where("home").groupBy("shard").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")))
    # 1: within each part of a shard
    homes = sent.where("home").join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int")).drop("home")
    inside = homes.select("fp", "doc_id", F.col("doc_id").alias("component"), F.lit(2).alias("side"), "shard", "part")
    first = textops.cut(_meet(inside, ["shard", "part"], within))
    named = connect(first).toDF("doc_id", "component")
    # 2: parts of one shard with each other, where there are several
    homes = textops.cut(homes.join(named, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    split = homes.where("parts > 1").drop("part", "parts").withColumn("weight", F.lit(1))
    tiles = _tiles(split, "shard", "weight", part, 1)
    sides = F.when(F.col("i") == F.col("j"), 2).when(F.col("part") == F.col("i"), 0).otherwise(1)
    second = _meet(tiles.withColumn("side", sides), ["bucket", "i", "j"], within)
    # 3: queries with the parts of the shards they ask
    queries = sent.where("NOT home").join(named, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    asking = textops.cut(queries.groupBy("shard").agg(F.ceil(F.count("*") / asked).cast("int").alias("asks")).join(sizes, "shard"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = homes.drop("parts").join(asking, "shard").withColumn("ask", all_of("asks")).withColumn("side", F.lit(0))
    right = queries.join(asking, "shard").withColumns({"ask": F.pmod(F.xxhash64("fp"), "asks").cast("int"), "side": F.lit(1)}).withColumn("part", all_of("parts"))
    columns = ["fp", "doc_id", "component", "side", "shard", "part", "ask"]
    third = _meet(left.select(columns).unionByName(right.select(columns)), ["shard", "part", "ask"], within)
    return first.unionByName(second).unionByName(third)


def components(docs: DataFrame, *, width: int = 3, within: int = 3, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Fingerprint (16 hexadecimal digits) and component of each row."""
    docs = textops.keyed(docs, {"doc_id": id_column, "text": text_column}).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = textops.cut(fingerprints(docs, width))
    usable = known.where("doc_id IS NOT NULL")
    equal = textops.cut(usable.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    near = textops.cut(links(equal.select("fp", F.col("rep").alias("doc_id")), within, **options))
    # an id with several fingerprints joins their representatives
    several = usable.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")
    also = usable.join(several, "doc_id", "left_semi").join(equal, "fp").select(F.col("doc_id").alias("x"), F.col("rep").alias("y"))
    named = textops.cut(connect(near.unionByName(also)).toDF("rep", "component"))
    return (
        known.join(equal, "fp", "left")
        .join(named, "rep", "left")
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))
    )
