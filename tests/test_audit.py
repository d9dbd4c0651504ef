"""Faults of every kind in small ledgers, projections and dates; evaluation of runs that come one by one."""

import pytest
from pyspark.sql import functions as F
from slotforge.functions import dates
from slotforge.operators import ledger, metrics, routing
from slotforge.queries.slots import routable

CLAIMS = [("c1", 1, "f", "10", True), ("c2", 2, "f", "20", True), ("c2b", 2, "f", "21", False), ("c3", 3, "f", None, True)]
DECISIONS = [("d1", "c1", None), ("d2", "c2b", None), ("d3", None, "33"), ("d4", "gone", None), ("d5", "c3", None)]


@pytest.mark.parametrize("slot,kinds", [
    ((1, "accepted", "10", "d1", "c1"), set()), ((1, "accepted", "11", "d1", None), {"accepted_not_of_claim"}), ((1, "accepted", "11", "d1", "c1"), {"accepted_not_of_claim", "row_not_of_claim"}),
    ((1, "accepted", "10", "d4", None), {"accepted_without_claim"}), ((1, "accepted", "10", None, None), {"accepted_without_claim"}), ((2, "accepted", "21", "d2", None), set()), ((3, "accepted", None, "d5", "c3"), set()),
    ((2, "corrected", "33", "d3", None), set()), ((2, "corrected", "34", "d3", None), {"corrected_not_of_decision"}), ((2, "corrected", "33", "none", None), {"corrected_not_of_decision"}), ((2, "corrected", None, "d1", None), set()),
    ((1, "rejected", "10", "d1", None), {"value_where_none_may_be"}), ((1, "rejected", None, "d1", None), set()), ((1, "confirmed_absent", "x", None, None), {"value_where_none_may_be"}), ((1, "not_applicable", "x", None, "c1"), {"value_where_none_may_be", "row_not_of_claim"}),
    ((1, "abstained", "10", None, None), {"value_where_none_may_be"}), ((1, "policy_confirmed_absent", None, "policy:r1", None), set()), ((1, "policy_confirmed_absent", None, "d1", None), {"absence_not_of_policy"}),
    ((1, "policy_confirmed_absent", None, None, None), {"absence_not_of_policy"}), ((1, "policy_confirmed_absent", "10", "policy:r1", None), {"absence_not_of_policy"}), ((2, "policy_accepted", "20", None, None), set()),
    ((2, "policy_accepted", "21", None, None), {"release_not_of_claim"}), ((9, "unreviewed_corroborated", "1", None, None), {"release_not_of_claim"}), ((3, "unreviewed_corroborated", None, None, None), set()),
    ((1, "accepted_unbound", "10", None, None), {"accepted_unbound"}), ((1, "pending", "anything", None, None), set()), ((1, None, "10", None, None), set()),
])
def test_projection_faults(spark, slot, kinds):
    doc, status, value, source, claim = slot
    delivered = spark.createDataFrame([(doc, "f", status, value, source, claim)], "doc_id long, field string, status string, value string, source string, claim_id string")
    claims = spark.createDataFrame(CLAIMS, "claim_id string, doc_id long, field string, value string, primary boolean")
    decisions = spark.createDataFrame(DECISIONS, "decision_id string, claim_id string, corrected_value string")
    assert {r.kind for r in ledger.projection_faults(delivered, claims, decisions).collect()} == kinds


def test_ledger_faults_of_every_kind(spark):
    rows = [("a", "t", 1, None), ("b", "t", 2, "a"), ("c", "u", 3, "b"), ("d", "t", 4, "e"), ("e", "t", 5, "d"), ("f", "t", 6, "nowhere"), ("a", "t", 7, "e"), ("g", "t", 8, "g")]
    found = ledger.chain_faults(spark.createDataFrame(rows, "decision_id string, target_id string, seq long, supersedes string")).collect()
    assert sorted(map(tuple, found)) == [("cross_slot", "c"), ("dangling", "f"), ("duplicate_id", "a"), ("forward", "d"), ("forward", "g")]


@pytest.mark.parametrize("text,want", [
    ("Jan  5, 2020", "2020-01-05"), ("January\t5,   2020", "2020-01-05"), ("5   Jan  2020", "2020-01-05"), ("Sept  12 2021", "2021-09-12"), ("12  december,  2019", "2019-12-12"), ("Feb  30, 2020", None),
])
def test_named_dates_with_any_blanks(spark, text, want):
    lines = spark.createDataFrame([(1, f"Invoice  Date: {text}"), (1, "Net 30")], "doc_id long, line string")
    row = dates.derive_due(lines).first()
    if want is None:
        assert (row.due, row.reason) == (None, "date_unreadable")
    else:
        assert row.reason is None and str(row.due) == str(spark.sql(f"SELECT date_add(DATE '{want}', 30) d").first().d)


def test_status_lists_are_sorted_names(spark):
    rows = [(1, n, "TIER1" if i % 2 else "TIER2", "policy_accepted" if i % 3 else "accepted") for i, n in enumerate(["total_net", "amount_due", "seller_name", "due_date", "buyer_name"])]
    rows += [(2, "due_date", "TIER1", "accepted")]
    found = {r.doc_id: (r.policy_disposed, r.tier1_policy_disposed) for r in ledger.documents(spark.createDataFrame(rows, "doc_id long, field string, tier string, status string")).collect()}
    assert found == {1: ("amount_due+buyer_name+seller_name", "amount_due"), 2: ("", "")}


SF = "/root/testdata/sf0.001"


def test_only_new_runs_are_scored(spark, tmp_path):
    slots = routable(spark, SF).where("doc_id < 90").withColumn("run", F.col("doc_id") % 3).persist()
    truth = slots.select("doc_id", "field", F.col("v").alias("want"))
    docs = slots.select("doc_id").distinct()
    policies = [routing.Policy("A"), routing.Policy("B", evidenced=(("E1", "total_vat"), ("E2", "due_date")))]
    probes = spark.createDataFrame([(0, True), (1, False)], "run long, available boolean")
    path = str(tmp_path / "scores")
    first = {(r.run, r.policy_id): r for r in metrics.score_new_runs(slots.where("run < 2"), path, truth, docs, policies, probes).collect()}
    changed = slots.withColumn("extraction_present", F.when(F.col("run") < 2, "fail").otherwise(F.col("extraction_present")))
    again = {(r.run, r.policy_id): r for r in metrics.score_new_runs(changed, path, truth, docs, policies, probes).collect()}
    assert {k: r for k, r in again.items() if k[0] < 2} == first and len(again) == 6
    assert first[0, "B"].hits > 0 == first[1, "B"].hits  # a run without probes, and one that is not listed, match no page evidence
    assert again[2, "B"].hits == 0 and not again[2, "B"].probes_available
    judged = metrics.against_baseline(spark.createDataFrame(list(first.values())), policies[0], policies[1:])
    assert metrics.gate(judged).first().refusals.split(",")[0] == "no_absence_probes"
    slots.unpersist()


def test_disputed_truth_is_set_apart(spark):
    slots = routable(spark, SF).where("doc_id < 120").persist()
    truth = slots.select("doc_id", "field", F.lit("there").alias("want"))  # every absence is silent
    docs, open_ = slots.select("doc_id").distinct(), slots.where("doc_id % 2 = 0").select("doc_id", "field")
    policies = [routing.Policy("A"), routing.Policy("B", absent=(("R", "due_date"),))]
    plain = metrics.evaluate(slots, truth, docs, policies[0], policies[1:]).first()
    apart = metrics.evaluate(slots, truth, docs, policies[0], policies[1:], disputes=open_).first()
    assert plain.silent_absent_new == apart.silent_absent_new + apart.disputed_new and 0 < apart.disputed_new < plain.silent_absent_new
    assert plain.rule_conflicts == apart.rule_conflicts + apart.rule_disputes and apart.rule_disputes > 0 == plain.rule_disputes
    every = metrics.gate(metrics.evaluate(slots, truth, docs, policies[0], policies[1:], disputes=slots.select("doc_id", "field"))).first()
    assert every.refusals == ""
    slots.unpersist()
