"""Streams that are stopped, begun again and left idle; results must be those of one batch over all rows."""

import random
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F
from slotforge.operators import ledger
from slotforge.queries import streaming
from slotforge.sources import readers
from slotforge.streaming import jobs

REQUEST = "doc_id long, mode string, request_id long, arrived_at timestamp, http_status int"


def requests(seed=1, n=300):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(12)]), rng.choice(["data", "read", None]), i, 1_700_000_000 + i // 3 * 60, rng.choice([200, 429, 500, 503, 503])) for i in range(n)]
    rows += [rng.choice(rows) for _ in range(40)]  # delivered twice
    return sorted(rows, key=lambda r: r[3])


def as_frame(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, mode string, request_id long, at long, http_status int")
    return made.select("doc_id", "mode", "request_id", F.timestamp_seconds("at").alias("arrived_at"), "http_status")


def expected(rows):
    out, done = set(), set()
    for doc, mode, request, at, status in sorted(set(rows), key=lambda r: (r[3], r[2])):
        if doc is not None and mode is not None and (doc, mode) not in done:
            out.add((doc, mode, request, status))
            if status == 200:
                done.add((doc, mode))
    return out


def stored(spark, store, schema):
    return [(r.doc_id, r.mode, r.request_id, r.http_status) for r in store.read(spark, schema).collect()]


@pytest.mark.parametrize("batches", [1, 5])
def test_failed_requests_are_asked_again_and_answered_ones_not(spark, tmp_path, batches):
    rows, store = requests(), jobs.Store(str(tmp_path / "store"))
    frame = as_frame(spark, rows)
    assert stored(spark, store, frame.schema) == []
    streaming.run(frame, jobs.intake, mode="append", at="arrived_at", beats=False, sink=store.write, batches=batches)
    found = stored(spark, store, frame.schema)
    assert len(found) == len(set(found)) and set(found) == expected(rows)


def test_a_batch_that_dies_is_run_again(spark, tmp_path):
    """The sink fails after it wrote the second batch and before the stream takes note; then half of it is torn off."""
    rows, store, seen = requests(2), jobs.Store(str(tmp_path / "store")), []
    frame = as_frame(spark, rows)
    each = streaming.arrive(frame, "arrived_at", str(tmp_path / "in"), beats=False)

    def sink(batch, epoch):
        store.write(batch, epoch)
        seen.append(epoch)
        if seen == [0, 1]:
            torn = sorted((tmp_path / "store" / "batch=1").glob("part-*"))
            torn[0].unlink()
            raise RuntimeError("lost")

    def go():
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", each).parquet(str(tmp_path / "in"))
        jobs.intake(stream).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost"):
        go()
    go()
    assert seen[:3] == [0, 1, 1] and len(seen) > 3
    found = stored(spark, store, frame.schema)
    assert len(found) == len(set(found)) and set(found) == expected(rows)


def test_files_arrive_in_order_of_time(spark, tmp_path):
    rows = requests(3)
    random.Random(1).shuffle(rows)
    each = streaming.arrive(as_frame(spark, rows).repartition(4), "arrived_at", str(tmp_path / "in"), beats=True)
    files = sorted((tmp_path / "in").glob("part-*"), key=lambda f: f.stat().st_mtime_ns)
    spans = [spark.read.parquet(str(f)).agg(F.min("arrived_at"), F.max("arrived_at")).first() for f in files]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False) if a[1] != b[1]) and len(files) >= 2 * each


def entries(seed, targets=25, n=240):
    rng, ids, rows = random.Random(seed), {}, []
    for i in range(n):
        t = f"T{rng.randrange(targets)}"
        before = rng.choice([None, None, *ids.get(t, [])[-3:]])
        rows.append((t, f"D{i}", i, before, rng.random() < 0.05))
        ids.setdefault(t, []).append(f"D{i}")
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("idle", ["0 seconds", "1 day"])
def test_tips_of_targets_that_leave_the_state(spark, idle):
    frame = spark.createDataFrame(entries(5), "target_id string, decision_id string, seq long, supersedes string, orphan boolean")
    lives = streaming.run(frame.drop("seq"), lambda s: jobs.tips(s, idle), ["target_id", "life"])
    order = ["target_id", "entries", "tips", "conflict", "tip_id"]
    assert sorted(map(tuple, jobs.projected(lives).select(order).collect())) == sorted(map(tuple, ledger.project(frame).select(order).collect()))
    assert (lives.count() > lives.select("target_id").distinct().count()) == (idle == "0 seconds")


def test_state_is_bounded_by_what_is_touched(spark, tmp_path):
    """Each batch touches targets of its own; at the end those of earlier batches are out of the state."""
    spark.createDataFrame([(f"T{i // 2}", f"D{i}", None, False) for i in range(400)], "target_id string, decision_id string, supersedes string, orphan boolean").repartitionByRange(4, "target_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        started = jobs.tips(stream, "100 milliseconds").writeStream.outputMode("update").foreachBatch(lambda b, e: (b.count(), time.sleep(0.3))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        started.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in started.recentProgress if p["numInputRows"]]
    assert len(rows) == 4 and rows[-1] < 110


def test_one_of_several_writers_at_once(spark, tmp_path):
    path, refused, done = str(tmp_path / "artifact"), [], []

    def write(k):
        try:
            readers.write_once(spark.range(500).withColumn("writer", F.lit(k)), path)
            done.append(k)
        except readers.AlreadyWritten:
            refused.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = readers.read_once(spark, path)
    assert len(done) == 1 and len(refused) == 3
    assert found.count() == 500 and {r.writer for r in found.select("writer").distinct().collect()} == set(done)
    assert [f.name for f in tmp_path.iterdir() if "staged" in f.name] == []


def test_a_lost_writer_leaves_a_whole_table_or_none(spark, tmp_path, monkeypatch):
    path, whole = str(tmp_path / "artifact"), spark.range(50)
    monkeypatch.setattr(readers, "_marker", lambda p: f"{tmp_path}/no-such-folder-{uuid.uuid4().hex}/\0")
    with pytest.raises(Exception):  # noqa: B017  lost before the marker
        readers.write_once(whole, path)
    monkeypatch.undo()
    assert not (tmp_path / "artifact").exists()
    finish = readers._finish
    monkeypatch.setattr(readers, "_finish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):  # lost between marker and rename
        readers.write_once(whole, path)
    monkeypatch.setattr(readers, "_finish", finish)
    with pytest.raises(readers.AlreadyWritten):
        readers.write_once(spark.range(3), path)
    assert readers.read_once(spark, path).count() == 50 and readers.read_once(spark, path).count() == 50
