"""The two main jobs from end to end on a small table."""

from pyspark.sql import functions as F
from slotforge.operators import routing
from slotforge.plans import runs
from slotforge.queries import base

SF = "/root/testdata/sf0.001"


def test_evidence_to_documents(spark, tmp_path):
    wide = base.wide(spark, SF).where("doc_id < 60")
    m1 = base.long(wide)
    none = spark.createDataFrame([], "doc_id long, field string, absence_evidence string")
    docs = wide.select("doc_id", (F.col("doc_id") % 97 == 0).alias("ocr_missing"))
    evidence = runs.Evidence(docs, m1, base.mode2(m1), base.readings(m1), base.citations(m1), wide.select("doc_id", F.lit("invoice").alias("doc_class")), none)
    runs.write_run(runs.evidence_to_routes(evidence, routing.Policy("P", absent=(("R1", "due_date", "invoice"),))), str(tmp_path))
    routed = spark.read.parquet(str(tmp_path / "slots"))
    n = wide.count()
    assert routed.count() == 10 * n and spark.read.parquet(str(tmp_path / "evaluations")).count() == 60 * n
    assert routed.where("route = 'auto_absent'").count() > 0
    open_ = routed.where("route = 'review'").orderBy("doc_id", "field").limit(3).collect()
    rows = [(i, f"D{i}", "S", f"{r.doc_id}/{r.field}", r.doc_id, r.field, "accept", None) for i, r in enumerate(open_)]
    rows.append((9, "D9", "S", f"{open_[0].doc_id}/{open_[0].field}", open_[0].doc_id, open_[0].field, "reject", "D0"))
    rows.append((10, "D10", "other", f"{open_[1].doc_id}/{open_[1].field}", open_[1].doc_id, open_[1].field, "reject", "D1"))
    decisions = spark.createDataFrame(rows, "seq long, decision_id string, snapshot string, target_id string, doc_id long, field string, decision string, supersedes string")
    slots, docs = runs.decisions_to_documents(routed, decisions, F.lit("S"))
    got = {(r.doc_id, r.field): r.status for r in slots.where("decision IS NOT NULL").collect()}
    assert [got[r.doc_id, r.field] for r in open_] == ["rejected", "accepted", "accepted"]
    assert docs.count() == n and {r.status for r in docs.collect()} <= {"blocked", "pending", "ready_for_approval"}
