"""The slot plan by documents against the one by evidence, and where slots are multiplied by policies."""

from pyspark.sql import functions as F
from slotforge.operators import gates, metrics
from slotforge.queries import base
from slotforge.queries.slots import POLICIES, routable

SF = "/root/testdata/sf0.001"


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_documents_give_the_slots_of_their_evidence(spark):
    m1 = base.long(base.wide(spark, SF))
    gathered = gates.slot_facts(gates.evidence(m1, base.mode2(m1), base.readings(m1), base.citations(m1)), base.states(spark, SF))
    made = base.slots(spark, SF).select(gathered.columns)
    assert made.exceptAll(gathered).isEmpty() and gathered.exceptAll(made).isEmpty() and made.count() > 1000
    assert "Window" not in _plan(made) and "collect_list" not in _plan(made)


def test_slots_meet_truth_before_they_are_multiplied(spark):
    slots = spark.createDataFrame(routable(spark, SF).withColumn("run", F.lit(0)).limit(50).collect(), routable(spark, SF).withColumn("run", F.lit(0)).schema)
    truth, docs = slots.select("doc_id", "field", F.col("v").alias("want")), slots.select("doc_id").distinct()
    rows = metrics.run_scores(slots, truth, docs, POLICIES)
    plan = _plan(rows)
    assert 0 <= plan.index("Generate inline") < plan.index("Join")
    own = slots.withColumns({"want": F.col("v"), "scored": F.lit(True)})
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, metrics.run_scores(own, None, None, POLICIES).collect()))
