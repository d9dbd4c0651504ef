"""The streaming jobs over the events table, run to the end of what is there."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotforge.operators import tables
from slotforge.queries import query
from slotforge.queries.base import table
from slotforge.queries.ledger import _TIPS, repaired
from slotforge.streaming import jobs


def arrive(frame: DataFrame, at: str, folder: str, beats: bool, batches: int = 4) -> int:
    """Writes the frame as files that a stream reads in order of the time ``at``; the files of a batch are returned.

    All tasks write at once, each a range of the time; then the files' times are set in the order of their names, which
    is that of the ranges. With ``beats`` heartbeats follow, all null but for times far enough ahead to close what is
    open: watermarks can be short.
    """
    spark = frame.sparkSession
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = to_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files = lambda: sorted(str(f.getPath()) for f in fs.listStatus(to_path(folder)) if f.getPath().getName().startswith("part-"))
    frame.repartitionByRange(max(batches, int(spark.conf.get("spark.sql.shuffle.partitions"))), at).write.parquet(folder)
    data = files()
    each = -(-len(data) // batches)
    if beats:
        end = frame.agg(F.max(at).alias("__end"))  # one row
        ahead = F.when(F.col("id") < each, F.expr("INTERVAL 30 DAYS")).otherwise(F.expr("INTERVAL 60 DAYS"))
        beat = spark.range(0, 2 * each, 1, 2 * each).crossJoin(F.broadcast(end))
        beat.select(*[(F.col("__end") + ahead).alias(c) if c == at else F.lit(None).cast(t).alias(c) for c, t in frame.dtypes]).write.mode("append").parquet(folder)
    had, now = set(data), int(time.time() * 1000)
    for i, f in enumerate([*data, *[f for f in files() if f not in had]]):  # one for each task that wrote
        fs.setTimes(to_path(f), now - 3_600_000 + 10 * i, -1)
    return each


def run(frame: DataFrame, job, key: list[str] | None = None, mode: str = "update", at: str | None = None, beats: bool = True, sink=None, batches: int = 4) -> DataFrame | None:
    """The frame written as files, read as a stream in four batches and run through the job; of several rows of a key the
    last counts. A ``sink`` takes the batches instead, and nothing is returned."""
    spark, folder = frame.sparkSession, f"{tables.shared_folder(frame.sparkSession)}/slotforge-stream-{uuid.uuid4().hex}"
    if at:
        each = arrive(frame, at, f"{folder}/in", beats, batches)
    else:
        frame.repartition(batches).write.parquet(f"{folder}/in")
        each = 1
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", each).parquet(f"{folder}/in")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/out/batch={epoch}")

    # timeouts of the clock would ask for batches without data for ever
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    spark.conf.set(empty, "false")
    try:
        started = job(stream).writeStream.outputMode(mode).foreachBatch(sink or keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        started.awaitTermination()
    finally:
        spark.conf.set(empty, before)
    if sink:
        return None
    out = spark.read.parquet(f"{folder}/out").drop("batch")
    if key:
        rest = [c for c in out.columns if c not in (*key, "epoch")]
        return out.groupBy(*key).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*key, "r.*")
    return out.drop("epoch")


@query("t1_decision_tips", f"WITH {_TIPS} SELECT target_id, entries, tips, tips <> 1 AS conflict, CASE WHEN tips = 1 THEN tip END AS tip_id FROM proj")
def t1(spark, d):
    """Tips of the ledger, from entries in four files in any order; targets that are not touched leave the state."""
    rows = repaired(spark, d).select("target_id", "decision_id", "supersedes", "orphan")
    return jobs.projected(run(rows, lambda s: jobs.tips(s, "1 second"), ["target_id", "life"]))


_REQUESTS = """rq AS (SELECT user_id doc_id, CASE WHEN event_id % 3 = 0 THEN 'data' ELSE 'read' END mode, event_id request_id, ts arrived_at, CASE event_type WHEN 'error' THEN 503 WHEN 'view' THEN 429 WHEN 'click' THEN 500 ELSE 200 END http_status FROM events),
fs AS (SELECT *, min(CASE WHEN http_status = 200 THEN {'t': arrived_at, 'i': request_id} END) OVER (PARTITION BY doc_id, mode) won FROM rq)"""


@query("t2_intake", f"WITH {_REQUESTS} SELECT doc_id, mode, count(*) AS attempts, count_if(http_status <> 200) AS failures, max(CASE WHEN http_status = 200 THEN request_id END) AS answered FROM fs WHERE won IS NULL OR {{'t': arrived_at, 'i': request_id}} <= won GROUP BY 1, 2")
def t2(spark, d):
    """Extractor calls as they come, one in ten delivered twice: failed ones are asked again, answered ones no more."""
    kind = F.col("event_type")
    status = F.when(kind == "error", 503).when(kind == "view", 429).when(kind == "click", 500).otherwise(200)
    mode = F.when(F.col("event_id") % 3 == 0, "data").otherwise("read")
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), mode.alias("mode"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("arrived_at"), status.alias("http_status"))
    rows = rows.unionByName(rows.where("request_id % 10 = 0"))
    store = jobs.Store(f"{tables.shared_folder(spark)}/slotforge-store-{uuid.uuid4().hex}")
    run(rows, jobs.intake, mode="append", at="arrived_at", beats=False, sink=store.write)
    stored = store.read(spark, rows.schema)
    won = F.col("http_status") == 200
    return stored.groupBy("doc_id", "mode").agg(F.count("*").alias("attempts"), F.count_if(~won).alias("failures"), F.max(F.when(won, F.col("request_id"))).alias("answered"))


_WORK_SQL = """WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) gap FROM events)
SELECT user_id AS reviewer, CAST(coalesce(sum(gap) FILTER (WHERE gap BETWEEN 0 AND 3600000000), 0) AS BIGINT) AS micros FROM g GROUP BY 1"""


@query("t3_working_time", _WORK_SQL)
def t3(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("reviewer"), F.col("ts").cast("timestamp").alias("decided_at"))
    # a session comes out once, when the watermark has passed its end
    found = run(rows, lambda s: jobs.sessions(s, "reviewer", late="1 hour"), mode="append", at="decided_at")
    return jobs.working_seconds(found.where("reviewer IS NOT NULL"), "reviewer")


@query("t4_route_counts", """SELECT date_trunc('day', ts) AS start, CASE event_type WHEN 'error' THEN 'block' WHEN 'purchase' THEN 'auto_accept' ELSE 'review' END AS route, count(*) AS slots FROM events GROUP BY 1, 2""")
def t4(spark, d):
    rules = spark.createDataFrame([("error", "block"), ("purchase", "auto_accept")], "strength string, route string")
    rows = table(spark, d, "events").select(F.col("event_type").alias("strength"), F.col("ts").cast("timestamp").alias("at"))
    found = run(rows, lambda s: jobs.route_counts(s, rules, "1 day", "1 hour"), ["start", "route"], at="at", beats=False)
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "route", "slots")

