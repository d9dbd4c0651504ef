"""Decision tips, intake, working time and route counters as streams (ids T1-T4 of the survey)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

LIVES = "target_id string, life string, entries long, open array<string>, gone array<string>"
_STATE = "life string, entries long, open array<string>, gone array<string>"


def tips(decisions: DataFrame, idle: str = "30 days") -> DataFrame:
    """What a batch knows of each target that it touched, by ``life``; run in update mode. Orphans are left out.

    State is open tips, and ids that were superseded before they came. It is dropped where a target was not touched for
    ``idle`` (of the clock); a later entry begins a new life. ``projected`` joins lives to the projection of all entries,
    so nothing is lost, and the state holds recently touched targets only.
    """
    wait = max(1, int(pd.Timedelta(idle).total_seconds() * 1000))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        life, n, open_, gone = (state.get[0], state.get[1], set(state.get[2]), set(state.get[3])) if state.exists else (None, 0, set(), set())
        for frame in frames:
            for entry, before in zip(frame["decision_id"], frame["supersedes"], strict=True):
                life = life or entry
                n += 1
                if isinstance(before, str):
                    if before in open_:
                        open_.discard(before)
                    else:
                        gone.add(before)
                if entry in gone:
                    gone.discard(entry)
                else:
                    open_.add(entry)
        state.update((life, n, sorted(open_), sorted(gone)))
        state.setTimeoutDuration(wait)
        yield pd.DataFrame([{"target_id": key[0], "life": life, "entries": n, "open": sorted(open_), "gone": sorted(gone)}])

    own = decisions.where("NOT orphan").select("target_id", "decision_id", "supersedes")
    return own.groupBy("target_id").applyInPandasWithState(update, LIVES, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def projected(lives: DataFrame) -> DataFrame:
    """(target_id, entries, tips, conflict, tip_id) from the last row of each life: open in one and superseded in none."""
    rows = lives.groupBy("target_id").agg(F.sum("entries").alias("entries"), F.flatten(F.collect_list("open")).alias("open"), F.flatten(F.collect_list("gone")).alias("gone"))
    left = F.array_except("open", "gone")
    return rows.select("target_id", "entries", F.size(left).cast("long").alias("tips"), (F.size(left) != 1).alias("conflict"), F.when(F.size(left) == 1, F.get(left, F.lit(0))).alias("tip_id"))


def orphans(decisions: DataFrame) -> DataFrame:
    """Entries bound to another snapshot, for a sink of their own."""
    return decisions.where("orphan")


def sessions(decisions: DataFrame, by: str, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(by, start, end, entries) of runs of entries at most a gap apart."""
    rows = decisions.withWatermark("decided_at", late)
    out = rows.groupBy(by, F.session_window("decided_at", gap).alias("s")).agg(F.count("*").alias("entries"), F.max("decided_at").alias("last"))
    return out.select(by, F.col("s.start").alias("start"), "last", "entries")


def working_seconds(session_rows: DataFrame, by: str) -> DataFrame:
    """(by, micros): time from the first to the last entry of each session; equals the sum of the gaps of up to an hour."""
    micros = F.unix_micros("last") - F.unix_micros("start")
    return session_rows.groupBy(by).agg(F.sum(micros).alias("micros"))


def intake(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """Requests (doc_id, mode, request_id, arrived_at, http_status), each delivery once within the watermark."""
    return requests.withWatermark("arrived_at", late).dropDuplicatesWithinWatermark(["doc_id", "mode", "request_id"])


class Store:
    """Results of extraction by batch: a document and mode is asked again until it succeeded, and then no more.

    ``write`` is a function for ``foreachBatch``. A batch has a folder of its own, which it overwrites: a batch that is
    run again after a failure leaves what it would have left. Of one batch, requests count in order of arrival.
    """

    KEY = ("doc_id", "mode")

    def __init__(self, path: str):
        self.path = path

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """All stored rows, with the number of their ``batch``; none where nothing was stored yet."""
        schema = StructType([*schema.fields, StructField("batch", LongType())])
        try:
            return spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)

    def write(self, batch: DataFrame, epoch: int) -> None:
        order, won = F.struct("arrived_at", "request_id"), F.col("http_status") == 200
        rows = batch.where("doc_id IS NOT NULL AND mode IS NOT NULL")
        first = rows.where(won).groupBy(*self.KEY).agg(F.min(order).alias("__first"))
        fresh = rows.join(first, [*self.KEY], "left").where(F.col("__first").isNull() | (order <= F.col("__first"))).select(*batch.columns)
        stored = self.read(batch.sparkSession, batch.schema).where(won & (F.col("batch") != epoch)).select(*self.KEY).distinct()
        fresh.join(stored, [*self.KEY], "left_anti").write.mode("overwrite").parquet(f"{self.path}/batch={epoch}")


def route_counts(slots: DataFrame, rules: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Slots by window and route; the route of a slot's strength comes from a small static table of rules."""
    rows = slots.withWatermark("at", late).join(F.broadcast(rules), "strength", "left")
    return rows.groupBy(F.window("at", width).alias("w"), F.coalesce("route", F.lit("review")).alias("route")).agg(F.count("*").alias("slots")).select(F.col("w.start").alias("start"), "route", "slots")
