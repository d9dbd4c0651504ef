"""Near-duplicate detection by HyperMinHash (operator 9).

Each document's distinct word shingles are hashed once; the high bits choose one of 256 buckets, and a bucket keeps
its least hash as a register of 6 bits of leading zeros and 10 bits of mantissa. Registers are banded, with as many
in a band as leave a pair at the threshold unseen once in 100,000 times at most. Pairs that share a band are estimated
from their registers, corrected for registers that agree by chance, and those that could reach the threshold are
verified on their full shingle sets. Links make components; each is named by its smallest id.

No group is expanded into pairs. Documents with equal sets are one representative. Then (1) each representative is
compared with the smallest one of the bands it shares, the one met most often, and links are joined to components;
(2) in bands whose members still are in several components, those whose estimate may reach the threshold form
clusters. Clusters are worked off in square tiles of bounded size; only members of different components are compared
there, and links are reported only where they join what was apart. So no link between different components stays unseen, and near copies in the
thousands cost a few comparisons each.

Cases: A-Z count as lower case; a text with fewer words than a shingle is one shingle; null texts and texts without
words have no shingles and are linked with nothing; rows with equal ids are one node (its links are those of all its
rows), each row with its own set size; a null id has a null component and is kept; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotforge.llm import textops
from slotforge.llm.textops import Words, mix, rolling

_U = np.uint64
REGISTERS, MANTISSA = 256, 10
#: Bytes of a row's registers with what belongs to them; of a part of a tile of sets; and rows of one of registers.
ROW_BYTES, TILE_BYTES, TILE_ROWS = 700, 8 << 20, 2000


def band_size(threshold: float, miss: float = 1e-5) -> int:
    """Most registers in a band for which a pair at the threshold shares no band with probability ``miss`` at most."""
    return max(r for r in range(1, 33) if r == 1 or (1 - threshold**r) ** (REGISTERS // r) <= miss)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, ascending."""
    w = Words(column, lower=True)
    hashes = rolling(w.hashes, width)
    with np.errstate(over="ignore"):
        for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
            if b - a >= width:
                own = np.sort(hashes[a : b - width + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                # the whole sequence as one shingle, unlike any of full width
                value = _U(b - a)
                for h in w.hashes[a:b]:
                    value = mix(np.array([value * _U(0x9E3779B97F4A7C15) + h]))[0]
                yield np.array([value])
            else:
                yield np.zeros(0, np.uint64)


def registers(own: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of an ascending set of hashes; 0 where a bucket is empty."""
    bucket = (own >> _U(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(own) else np.zeros(0, np.int64)
    out = np.zeros(REGISTERS, np.uint16)
    rest = ((own[first] << _U(8)) >> _U(11)).astype(np.float64) + 0.5  # 53 bits
    mantissa, exponent = np.frexp(rest)
    zeros = np.minimum(53 - exponent, 62)
    out[bucket[first]] = 1 + ((zeros << MANTISSA) | ((2 * mantissa - 1) * (1 << MANTISSA)).astype(np.int64))
    return out


def bands(regs: np.ndarray, size: int) -> np.ndarray:
    """A key for each band that has a register, the band's number mixed in; rows of ``regs`` are documents."""
    n = REGISTERS // size
    table = regs[: n * size].reshape(n, size).astype(np.uint64)
    key = np.arange(n, dtype=np.uint64)
    for k in range(size):
        key = mix(key * _U(0x9E3779B97F4A7C15) + table[:, k])
    return key[table.any(axis=1)]


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard of registers (broadcast over leading axes), corrected for chance agreement of mantissas."""
    used = (a > 0) | (b > 0)
    same = ((a == b) & used).sum(-1)
    n = np.maximum(used.sum(-1), 1)
    raw, chance = same / n, 2.0 ** -(MANTISSA + 1)
    return np.clip((raw - chance) / (1 - chance), 0, 1)


def may_reach(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the estimate is within four standard errors of the threshold."""
    n = np.maximum(((a > 0) | (b > 0)).sum(-1), 1)
    return estimate(a, b) >= threshold - 4 * np.sqrt(threshold * (1 - threshold) / n)


def sketch(docs: DataFrame, width: int, size: int) -> DataFrame:
    """(doc_id, n, a, b, regs, bands): set size, set identity, registers and band keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, 1, 2 << 20):
                n, a, b, regs, keys = [], [], [], [], []
                for own in shingle_sets(part.column(1), width):
                    r = registers(own)
                    n.append(len(own))
                    a.append(int(np.add.reduce(mix(own)).view(np.int64)) if len(own) else 0)
                    b.append(int(np.add.reduce(mix(own + _U(1)) ^ (own << _U(1))).view(np.int64)) if len(own) else 0)
                    regs.append(r.tobytes())
                    keys.append(bands(r, size).view(np.int64))
                at = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(regs, pa.binary()), listed]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "a", "b", "regs", "bands"])

    return docs.mapInArrow(textops.releasing(run), "doc_id long, n long, a long, b long, regs binary, bands array<long>")


def connect(links: DataFrame) -> DataFrame:
    """(id, component) for the ends of the links (x, y), but for each component's least id itself.

    Large-star and small-star rounds until nothing changes.
    """
    edges = textops.cut(links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct())
    last = None
    while True:
        # large star: each node hands its larger neighbours to the least of its neighbours and itself
        both = edges.union(edges.select("y", "x")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        # small star: each node hands its smaller neighbours, and itself, to the least of them
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        edges = textops.cut(small.union(low.select("x", F.col("m").alias("y"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.toDF("id", "component")
        last = now


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, own) of the documents with the given ids, and a few others; no text is shuffled."""
    bits = textops.IdBits(ids.select("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.filter(pa.array(bits.has(batch.column(2).to_numpy())))
            for part in textops.slices(wanted, 1):
                own = pa.array([s.tobytes() for s in shingle_sets(part.column(1), width)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), own], ["doc_id", "own"])

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", bits.slot(F.col("doc_id")).alias("slot"))
    return rows.mapInArrow(textops.releasing(run), "doc_id long, own binary")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (x, y) of ids whose full shingle sets have 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one, other = pairs.select(F.col("x").alias("doc_id")).distinct(), pairs.select(F.col("y").alias("doc_id")).distinct()
    first, second = sets_of(docs, one, width).toDF("x", "own_x"), sets_of(docs, other, width).toDF("y", "own_y")
    return pairs.join(first, "x").join(second, "y").select("x", "y", "own_x", "own_y").mapInArrow(textops.releasing(check), "x long, y long").distinct()


def _tiles(rows: DataFrame, key: str, weight: str, most: int, buckets: int) -> DataFrame:
    """Each group dealt to parts of about ``most`` bytes, by the ``weight`` of its rows; (bucket, i, j) are pairs of parts,
    and a row is in each pair of its part.

    The group's largest component has parts of its own, which need not meet each other: a row of it is sent only to where
    the other components' parts are. Small groups have one part and share buckets, so that a call has many of them.
    """
    sums = rows.groupBy(key, "component").agg(F.sum(weight).alias("__c"))
    sums = sums.groupBy(key).agg(F.max_by("component", F.struct("__c", "component")).alias("__main"), F.max("__c").alias("__own"), F.sum("__c").alias("__all"))
    dealt = rows.join(sums, key)
    small, large, h = F.col("__all") <= most, F.col("component") == F.col("__main"), F.hash("doc_id")
    parts = lambda w: F.greatest(F.ceil(w / most), F.lit(1)).cast("int")
    a, b = parts(F.col("__own")), parts(F.col("__all") - F.col("__own"))
    part = F.when(small, 0).when(large, F.pmod(h, a)).otherwise(a + F.pmod(h, b))
    others = F.when(small, F.array(F.lit(0))).when(large, F.sequence(a, a + b - 1)).otherwise(F.sequence(F.lit(0), a + b - 1))
    bucket = F.when(small, F.pmod(F.xxhash64(key), F.lit(buckets))).otherwise(F.xxhash64(key))
    other = dealt.withColumns({"part": part, "__other": others, "bucket": bucket}).withColumn("__other", F.explode("__other"))
    return other.withColumns({"i": F.least("part", "__other"), "j": F.greatest("part", "__other")}).drop("__main", "__own", "__all", "__other", weight)


def _buckets(members: DataFrame, weight: str) -> int:
    return int(-(-(members.agg(F.sum(weight)).first()[0] or 0) // TILE_BYTES)) + 1


def _groups(table: pa.Table, key: str) -> Iterator[dict]:
    """The columns of each group of a call, as arrays."""
    names = table.column(key).to_numpy()
    order = np.argsort(names, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, names[order][1:] != names[order][:-1])), len(names)) if len(names) else np.zeros(1, np.int64)
    columns = {c: table.column(c).to_numpy()[order] for c in ("doc_id", "component", "part", "sets")}
    regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)[order]
    own = table.column("own").to_pylist() if "own" in table.column_names else None
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        group = {c: v[a:b] for c, v in columns.items()} | {"regs": regs[a:b]}
        yield group | ({"own": [np.frombuffer(own[k], np.uint64) for k in order[a:b]]} if own else {})


def _links(x: list[int], y: list[int]) -> pa.Table:
    return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})


def similar(inside: DataFrame, regs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (x, y) that connect all documents of one band whose estimate may reach the threshold; a spanning set of them.

    ``inside`` has band, doc_id, component, members; documents of one component are connected already.
    """
    inside = inside.withColumn("members", F.lit(1))
    tiles = _tiles(inside, "band", "members", TILE_ROWS, -(-inside.count() // (10 * TILE_ROWS)) + 1).join(regs.select("doc_id", "regs", "sets"), "doc_id")

    def spanning(key: tuple, table: pa.Table) -> pa.Table:
        i, j, x, y = key[1].as_py(), key[2].as_py(), [], []
        for g in _groups(table, "band"):
            ids, before, part, r, several = g["doc_id"], g["component"], g["part"], g["regs"], g["sets"] > 1
            label, met = before.copy(), []
            right = np.flatnonzero(part == j)
            for k in np.flatnonzero(part == i):
                against = right[label[right] != label[k]]
                if len(against):
                    hit = against[several[against] | several[k] | may_reach(r[against], r[k], threshold)]
                    if len(hit):
                        found = np.unique(label[hit])
                        x += [int(label[k])] * len(found)
                        y += found.tolist()
                        met += [int(label[k]), *found.tolist()]
                        label[np.isin(label, found)] = label[k]
            if met:
                # every document here of a component that meets another one
                own = np.isin(before, np.array(met, np.int64))
                x += ids[own].tolist()
                y += before[own].tolist()
        return _links(x, y)

    return tiles.groupBy("bucket", "i", "j").applyInArrow(spanning, "x long, y long").distinct()


def cross_links(members: DataFrame, docs: DataFrame, regs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (x, y) between the components of each cluster: (doc_id, component, cluster) to a spanning set of links.

    A cluster's documents are dealt to parts of about ``TILE_BYTES`` of sets (one document may be longer); each pair of
    parts is a group, in which documents of different components are estimated and, if that may reach the threshold,
    verified. A group emits a link only if it joins what was apart in it, so it emits fewer links than it has documents.
    """
    threshold = percent / 100
    weighed = members.join(regs.select("doc_id", (8 * F.col("n") + ROW_BYTES).alias("weight")), "doc_id")
    dealt = textops.cut(_tiles(weighed, "cluster", "weight", TILE_BYTES, _buckets(weighed, "weight")))
    tiles = dealt.join(sets_of(docs, members, width), "doc_id").join(regs.select("doc_id", "regs", "sets"), "doc_id")

    def crossing(key: tuple, table: pa.Table) -> pa.Table:
        i, j, x, y = key[1].as_py(), key[2].as_py(), [], []
        for g in _groups(table, "cluster"):
            ids, label, part, r, own, several = g["doc_id"], g["component"].copy(), g["part"], g["regs"], g["own"], g["sets"] > 1
            right = np.flatnonzero(part == j)
            for k in np.flatnonzero(part == i):
                against = right[(label[right] != label[k]) & ((ids[right] < ids[k]) | (i != j))]
                if not len(against):
                    continue
                about = estimate(r[against], r[k])
                may = may_reach(r[against], r[k], threshold) | several[against] | several[k]
                for n in against[may][np.argsort(-about[may], kind="stable")]:
                    if label[n] != label[k]:
                        both = len(np.intersect1d(own[k], own[n], assume_unique=True))
                        if 100 * both >= percent * (len(own[k]) + len(own[n]) - both):
                            label[label == label[n]] = label[k]
                            x.append(int(ids[k]))
                            y.append(int(ids[n]))
        return _links(x, y)

    return tiles.groupBy("bucket", "i", "j").applyInArrow(crossing, "x long, y long")


def components(
    docs: DataFrame, *, width: int = 3, percent: int = 85, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Set size, component and verdict of each row."""
    threshold = percent / 100
    docs = textops.keyed(docs, {"doc_id": id_column, "text": text_column}).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = textops.cut(sketch(docs, width, band_size(threshold)))
    usable = known.where("n > 0 AND doc_id IS NOT NULL")
    equal = usable.groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"))
    copies = usable.join(equal, ["n", "a", "b"]).select(F.col("doc_id").alias("x"), F.col("rep").alias("y")).distinct()
    reps = equal.select(F.col("rep").alias("doc_id")).distinct()
    kept = usable.join(reps, "doc_id", "left_semi")  # an id with several sets stays with all of them
    member = kept.select(F.explode("bands").alias("band"), "doc_id").distinct()
    hubs = member.groupBy("band").agg(F.min("doc_id").alias("hub"), F.count("*").alias("members")).where("members > 1").drop("members")
    shared = textops.cut(member.join(hubs, "band"))

    best = shared.where("doc_id <> hub").groupBy("doc_id", "hub").count().groupBy("doc_id").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub"))
    regs = kept.groupBy("doc_id").agg(F.max("regs").alias("regs"), F.count("*").alias("sets"), F.max("n").alias("n"))

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(i)]) for i in (2, 3))
                sure = np.array(batch.column(4).to_pylist(), bool)
                yield batch.select([0, 1]).filter(pa.array(sure | may_reach(a, b, threshold)))

    pairs = (
        best.toDF("x", "y").join(regs.drop("n").toDF("x", "regs_x", "sets_x"), "x").join(regs.drop("n").toDF("y", "regs_y", "sets_y"), "y")
        .select("x", "y", "regs_x", "regs_y", (F.col("sets_x") + F.col("sets_y") > 2).alias("several"))
        .mapInArrow(textops.releasing(estimated), "x long, y long")
    )
    first = textops.cut(verified(textops.cut(pairs), docs, width, percent).union(copies.where("x <> y")))
    named = textops.cut(connect(first))

    # bands whose members are in several components; documents of theirs that may be similar are one cluster
    placed = shared.join(named.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = textops.cut(placed.select("band", "doc_id", "component"))
    open_ = placed.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("members")).where("a < b")
    inside = placed.join(open_.select("band"), "band")
    cluster = connect(similar(inside, regs, threshold)).toDF("doc_id", "cluster")
    cluster = cluster.union(cluster.select("cluster", "cluster").distinct())  # the least of each has no row of its own
    members = cluster.join(named.toDF("doc_id", "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    second = cross_links(textops.cut(members), docs, regs, width, percent)
    final = connect(first.union(second))
    return (
        known.select("doc_id", F.col("n").alias("n_shingles"))
        .join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, *, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each component, with all its columns; of rows that repeat an id, those with equal values once.

    Only rows that may have to go are shuffled; the others pass as they are.
    """
    found = components(docs, width=width, percent=percent, id_column=id_column, text_column=text_column).where("doc_id IS NOT NULL")
    gone = textops.cut(found.where("NOT kept").select("doc_id").distinct())
    again = textops.cut(found.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    bits, own = textops.IdBits(gone.union(again)), F.col(f"`{id_column}`")
    passed, doubtful = docs.where(~bits.among(own)), docs.where(bits.among(own))
    name = textops.free_name(docs)
    listed = own.cast("long") == F.col(name)
    rest, twice = doubtful.join(gone.toDF(name), listed, "left_anti"), again.toDF(name)
    return passed.unionByName(rest.join(twice, listed, "left_anti")).unionByName(rest.join(twice, listed, "left_semi").dropDuplicates())
