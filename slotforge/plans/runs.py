"""The two main jobs as lazy plans over the operators; the slot table is the one table that is written between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotforge.operators import gates, ledger, routing
from slotforge.sources import readers


@dataclass(frozen=True)
class Evidence:
    """Inputs of a run: what could not be read of each document, two extractors' values, readings, and citation results."""

    docs: DataFrame  # doc_id and the flags of gates.STATES
    first: DataFrame
    second: DataFrame
    readings: DataFrame
    citations: DataFrame
    classes: DataFrame  # doc_id, doc_class
    absences: DataFrame  # doc_id, field, absence_evidence


def evidence_to_routes(evidence: Evidence, policy: routing.Policy) -> DataFrame:
    """Slots with verdicts, strength, route and reasons."""
    slots = gates.slot_facts(gates.evidence(evidence.first, evidence.second, evidence.readings, evidence.citations), evidence.docs)
    slots = slots.join(evidence.classes, "doc_id", "left").join(evidence.absences, ["doc_id", "field"], "left")
    return routing.route(slots, policy)


def write_run(routed: DataFrame, folder: str) -> None:
    """The artifacts of a run: the slot table, then findings and evaluations from what was written."""
    readers.write_once(routed, f"{folder}/slots")
    slots = readers.read_once(routed.sparkSession, f"{folder}/slots")
    readers.write_once(gates.findings(slots), f"{folder}/findings")
    readers.write_once(gates.evaluations(slots), f"{folder}/evaluations")


def decisions_to_documents(routed: DataFrame, decisions: DataFrame, snapshot: Column, tier1_explicit: bool = True) -> tuple[DataFrame, DataFrame]:
    """(slots with status, documents with status). ``decisions`` also has doc_id and field."""
    own = ledger.repair(decisions, snapshot)
    tips = ledger.project(own).where("NOT conflict").select(F.col("tip_id").alias("decision_id"))
    decided = own.join(tips, "decision_id").select("doc_id", "field", "decision")
    delivered = ledger.deliver(routed, decided, tier1_explicit)
    return delivered, ledger.documents(delivered)
