"""Hierarchical weighted hash tree (operator 3): region, rack and shard levels, descended by weighted hash draws.

A leaf draws ``-ln(u) / weight`` with u hashed from the key and the leaf's name; a rack's draw is the least of its
shards' draws and a region's the least of its racks', so each subtree's draw is exponential with the sum of its
weights. A key descends to the child with the least draw at each level. Only subtrees whose weights change change
their draws: a heavier (or new) shard draws keys to itself alone, and a lighter one gives keys away only.

All of it is column expressions over the key; one shuffle of ids numbers the slots. The slot order is by bucket, with
buckets hashed from the key and the text's size and checksum: counts of (shard, bucket) give each bucket's first slot,
so neither a shard's rows nor different texts of one key meet in one task.

Cases: a null key counts as the text ``null``; rows with equal keys share a shard and get slots of their own; null
text has size 1 and the checksum of the empty string; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotforge.llm import textops


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(shards: int, per_rack: int = 4, per_region: int = 8) -> list[Leaf]:
    """A tree of equal shards, filled rack by rack; one more shard adds one leaf and leaves the others as they are."""
    return [Leaf(f"g{i // per_region}", f"k{i // per_rack}", i) for i in range(shards)]


def _draw(key: Column, leaf: Leaf) -> Column:
    word = F.substring(F.md5(F.concat(key, F.lit(f"/{leaf.shard}")).cast("binary")), 1, 12)
    unit = (F.conv(word, 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(unit) / F.lit(float(leaf.weight))


def _descend(leaves: list[Leaf], draws: dict[int, str], levels: tuple[str, ...] = ("region", "rack")) -> Column:
    """The shard that the key reaches: at each level the child with the least draw."""
    if not levels or len(leaves) == 1:
        best = F.least(*[F.col(draws[x.shard]) for x in leaves]) if len(leaves) > 1 else None
        chosen = F.lit(leaves[-1].shard)
        for x in reversed(leaves[:-1]):
            chosen = F.when(F.col(draws[x.shard]) == best, x.shard).otherwise(chosen)
        return chosen
    children: dict[str, list[Leaf]] = {}
    for x in leaves:
        children.setdefault(getattr(x, levels[0]), []).append(x)
    subtree = [F.array_min(F.array(*[F.col(draws[x.shard]) for x in group])) for group in children.values()]
    below = [_descend(group, draws, levels[1:]) for group in children.values()]
    if len(below) == 1:
        return below[0]
    best, chosen = F.least(*subtree), below[-1]
    for draw, child in list(zip(subtree, below, strict=True))[-2::-1]:
        chosen = F.when(draw == best, child).otherwise(chosen)
    return chosen


def with_shard(rows: DataFrame, key: Column, targets: dict[str, list[Leaf]]) -> DataFrame:
    """The rows with one column for each named tree: the shard that the key reaches in it."""
    leaves = {x: None for t in targets.values() for x in t}
    names = {x: f"__draw_{i}" for i, x in enumerate(leaves)}
    drawn = rows.select("*", *[_draw(key, x).alias(n) for x, n in names.items()])
    out = [_descend(t, {x.shard: names[x] for x in t}).cast("int").alias(name) for name, t in targets.items()]
    return drawn.select(*[F.col(f"`{c}`") for c in rows.columns], *out)


def assign(
    docs: DataFrame, leaves: list[Leaf], grown: list[Leaf], *, id_column: str = "doc_id", text_column: str = "text", buckets: int = 1024
) -> DataFrame:
    """Shard, slot and size of each document, and the shard it would have in the grown tree."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    sized = textops.keyed(docs, {"doc_id": id_column, "text": text_column}).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    name = F.concat_ws("/", key, F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    bucket = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % buckets
    counts = with_shard(sized, key, {"shard": leaves}).groupBy("shard", bucket.alias("bucket")).count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most (shards x buckets) rows, whatever the input
    first = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    placed = with_shard(sized, key, {"shard": leaves, "grown_shard": grown}).withColumn("bucket", bucket)
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1)
    return ranked.join(F.broadcast(first), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"), "grown_shard"
    )
