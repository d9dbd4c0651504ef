"""Feedback entries whose made ids are equal."""

from pyspark.sql import functions as F
from slotforge.operators import ledger
from slotforge.queries import ledger as ledger_queries


def _flags(spark, *keys):
    # the first two are of different slots, and their ids, made from 32 bits of content, are equal
    rows = [(20, "T1", "legacy-1", None, "accept"), (21, "T2", "legacy-1", None, "accept"), (40, "T3", "legacy-1", None, "reject"), (43, "T3", "D43", "legacy-1", "correct")]
    entries = spark.createDataFrame(rows, "seq long, target_id string, decision_id string, supersedes string, decision string")
    entries = entries.withColumns({"orphan": F.lit(False), "wellfounded": F.lit(True)})
    found = ledger.feedback(entries, entries.where("seq % 20 = 0").select(*keys))
    return {r.seq: (r.random_qa, r.superseded, r.qualified) for r in found.collect()}, found.count()


def test_probe_is_one_entry(spark):
    found, n = _flags(spark, "target_id", "seq", "decision_id")
    assert n == 4 and found == {20: (True, False, False), 21: (False, False, True), 40: (True, True, False), 43: (False, False, True)}


def test_probes_by_id_alone(spark):
    assert _flags(spark, "decision_id")[0][21] == (True, False, False)


def test_cohorts_keep_an_entry_with_a_drawn_ones_id(spark, tmp_path):
    # both get the same id from their content; the first is drawn at random
    rows = [(10903320, 1, "signup"), (73269, 4, "signup")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").withColumn("ts", F.current_timestamp()).write.parquet(f"{tmp_path}/events.parquet")
    ids = [r.decision_id for r in ledger_queries.repaired(spark, str(tmp_path)).collect()]
    assert len(set(ids)) == 1 and ids[0].startswith("legacy-")
    found = [(r.field, r.route, r.reviewed, r.accepted) for r in ledger_queries.a14(spark, str(tmp_path)).collect()]
    assert found == [("due_date", 1, 1, 1)]
