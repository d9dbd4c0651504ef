"""Sampling, digests, set checks and dense ids (ids V11-V13, V15, A34-A36, A40, J11, J17-J20, O1-O4, R8, R10, R11 of the survey)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotforge.functions import values as V
from slotforge.operators import routing


def equidistant(pool: DataFrame, key: str, n: int) -> DataFrame:
    """(idx, key): n ids at even distances in the sorted pool."""
    size = pool.count()
    placed = routing.ranked(pool.select(key), F.col(key))
    wanted = pool.sparkSession.range(n).select(F.col("id").alias("idx"), F.floor(F.col("id") * size / n).alias("position"))
    return placed.join(F.broadcast(wanted), "position").select("idx", key)


def hash_split(pool: DataFrame, key: str, salt: str, n: int, *strata: str) -> DataFrame:
    """The pool with ``part``: the n ids of each stratum with the least salted hashes are ``evaluation``, others ``development``.

    Only ids whose hash is below a bound that leaves about three times n are ranked; the bound grows with the stratum.
    """
    h = F.sha2(F.concat_ws("|", F.lit(salt), F.col(key).cast("string")), 256)
    hashed = pool.withColumn("__h", h)
    groups = list(strata)
    sizes = hashed.groupBy(*groups).agg(F.count("*").alias("__n"))
    hashed = hashed.join(F.broadcast(sizes), groups) if groups else hashed.crossJoin(F.broadcast(sizes))  # one row for each stratum
    unit = F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    near = hashed.where(unit < F.lit(max(3.0 * n, 50.0)) / F.col("__n"))
    w = Window.partitionBy(*groups).orderBy("__h", key)
    chosen = near.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).select(key, *groups, F.lit(True).alias("__c"), ((F.col("__r") - 1) / 20).cast("int").alias("block"))
    out = hashed.join(chosen, [key, *groups], "left")
    return out.withColumn("part", F.when(F.col("__c"), "evaluation").otherwise("development")).drop("__h", "__n", "__c")


def dense_ids(frame: DataFrame, prefix: str, *order: Column) -> DataFrame:
    """``id``: prefix and number from 1 in a total order."""
    return routing.ranked(frame, *order).withColumn("id", F.format_string(f"{prefix}-%06d", F.col("position") + 1)).drop("position")


def content_digest(frame: DataFrame, *columns: str) -> DataFrame:
    """(rows, digest): the same for the same rows in any order; sums of row hashes, so nothing is gathered."""
    word = lambda i: F.sum(F.conv(F.substring("__h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    hashed = frame.select(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256).alias("__h"))
    return hashed.agg(F.count("*").alias("rows"), word(0).alias("a"), word(1).alias("b")).select("rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("digest"))


def set_digests(frame: DataFrame, key: str, *groups: str) -> DataFrame:
    """(groups, n, digest) of the distinct ids of each group, in any order; sums of id hashes, so no group is gathered."""
    word = lambda i: F.coalesce(F.sum(F.conv(F.substring("__h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    ids = frame.select(*groups, F.col(key).cast("string").alias("__id")).distinct().withColumn("__h", F.sha2("__id", 256))
    summed = ids.groupBy(*groups).agg(F.count("__id").alias("n"), word(0).alias("__a"), word(1).alias("__b"))
    return summed.select(*groups, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), "__a", "__b"), 256).alias("digest"))


def snapshot(tables: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """(name, rows, digest) of each table, in the order of names; equal inputs have equal rows."""
    parts = [content_digest(f, *c).select(F.lit(n).alias("name"), "rows", "digest") for n, (f, c) in sorted(tables.items())]
    return reduce(lambda a, b: a.unionByName(b), parts)


def exposure(lists: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, reasons, n): one row for each id on any of the lists, with the lists' names."""
    rows = reduce(lambda a, b: a.unionByName(b), [f.select(key, F.lit(n).alias("reason")) for n, f in lists.items()])
    return rows.distinct().groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("reason")), "+").alias("reasons"), F.count("*").alias("n"))


def unlike(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, n): how many ids are in both, in the first or in the second only."""
    both = a.select(key).distinct().withColumn("l", F.lit(True)).join(b.select(key).distinct().withColumn("r", F.lit(True)), key, "full_outer")
    side = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "first").otherwise("second")
    return both.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def identity_faults(arms: DataFrame) -> DataFrame:
    """(artifact, digests): artifacts that should be one over all arms and are not. ``arms`` has arm, artifact, digest."""
    return arms.groupBy("artifact").agg(F.count_distinct("digest").alias("digests")).where("digests > 1")


def evidence_state(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state): ok, swapped, missing or absent_at_run."""
    both = recorded.select("path", F.col("digest").alias("was")).join(current.select("path", F.col("digest").alias("now")), "path", "full_outer")
    return both.select("path", F.when(F.col("was").isNull(), "absent_at_run").when(F.col("now").isNull(), "missing").when(F.col("was") != F.col("now"), "swapped").otherwise("ok").alias("state"))


def valid_suggestions(rows: DataFrame, notes: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    """(id, refused): action known, field known, every cited note exists, text short enough; null is kept."""
    cited = rows.select("id", F.explode("cites").alias("note_id")).join(notes.select("note_id"), "note_id", "left_anti").select("id", F.lit(True).alias("lost")).distinct()
    judged = rows.join(cited, "id", "left")
    return judged.select("id", F.when(~F.col("action").isin(*actions), "unknown_action").when(~F.col("field").isin(*V.NAMES), "unknown_field").when(F.col("lost"), "unknown_note").when(F.length("text") > 200, "too_long").alias("refused"))


def blind(slots: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Only the columns that a reviewer may see."""
    return slots.select(*allowed)


def first_seen(frame: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """One row for each key, of the source with the least priority."""
    rest = [c for c in frame.columns if c not in keys]
    return frame.groupBy(*keys).agg(F.min_by(F.struct(*rest), priority).alias("r")).select(*keys, "r.*")


def run_identity(tables: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """One row with a digest for each input of a run; None in place of a table that the run did not have."""
    parts = [content_digest(f, *c).select(F.col("digest").alias(n)) if f is not None else None for n, (f, c) in tables.items()]
    have = reduce(lambda a, b: a.crossJoin(b), [p for p in parts if p is not None])  # one row each
    return have.select(*[F.col(n) if p is not None else F.lit(None).cast("string").alias(n) for n, p in zip(tables, parts, strict=True)])


def bind_identity(evaluation: DataFrame, identity: DataFrame) -> DataFrame:
    """The evaluation with the identity of the run that it was made on."""
    return evaluation.crossJoin(F.broadcast(identity))


def identity_changes(evaluation: DataFrame, identity: DataFrame) -> DataFrame:
    """(candidate, changed): the inputs that are not what the evaluation was made on, in order; empty if it still holds."""
    now = identity.toDF(*[f"__{c}" for c in identity.columns])
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), c) for c in identity.columns]))
    return evaluation.crossJoin(F.broadcast(now)).select("candidate", F.array_join(changed, ",").alias("changed"))
