"""Append-only ledgers (ids S7, V1, V2, V14, V16, V17, F20, R6, R7, R9, A5, A6, A13, A25-A27, J13, J15, J16 of the survey)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotforge.functions import values as V
from slotforge.operators import ordered

GAP_SECONDS = 3600
#: Decisions, the status that each gives, statuses by what they mean, reason codes, the decisions that
#: some of them belong to, and the fields whose state keeps a document from being posted under a release profile.
DECISIONS = ("accept", "correct", "reject", "confirm_absent", "not_applicable", "abstain")
STATUS = {"correct": "corrected", "accept": "accepted", "confirm_absent": "confirmed_absent", "not_applicable": "not_applicable", "reject": "rejected", "abstain": "abstained"}
BLOCKING_ALL = ("pending", "pending_tier1", "abstained")
BLOCKING_PROFILE = ("pending", "abstained")
POLICY_STATUS = ("policy_accepted", "policy_confirmed_absent", "unreviewed_corroborated")
PROFILES = {
    "payment_required_v1": ("invoice_number", "seller_name", "amount_due"),
    "posting_required_v1": ("invoice_number", "seller_name", "amount_due", "issue_date", "seller_vat_id"),
}
REASON_CODES = (
    "WRONG_VALUE", "WRONG_FIELD_MAPPING", "BAD_SOURCE_BINDING", "MISSING_EXTRACTION", "NORMALIZATION_ERROR", "ROUTING_FALSE_NEGATIVE", "ROUTING_FALSE_POSITIVE",
    "CONFIRMED_ABSENT", "NOT_APPLICABLE", "AMBIGUOUS_DOCUMENT", "PROVIDER_FAILURE", "REVIEWER_PREFERENCE", "OTHER",
)
CODE_DECISIONS = {"CONFIRMED_ABSENT": ("confirm_absent",), "NOT_APPLICABLE": ("not_applicable",), "WRONG_VALUE": ("correct", "reject"), "ROUTING_FALSE_POSITIVE": ("accept", "confirm_absent")}
CONFIDENCES = ("high", "medium", "low")
SEEN = r"^(?:split|blind|agree(?:_rejected)?:[^\t\n\r]{1,2000})$"
RESOLVED = ("corrected", "accepted", "confirmed_absent", "not_applicable", "policy_accepted", "policy_confirmed_absent")


def repair(rows: DataFrame, snapshot: Column) -> DataFrame:
    """Old rows without an id get one from their content, and follow the row before them in their slot; rows bound to
    another snapshot are orphans."""
    made = F.concat(F.lit("legacy-"), F.substring(F.sha2(F.concat_ws("|", "target_id", "seq", "decision"), 256), 1, 8))
    named = rows.withColumns({"legacy": F.col("decision_id").isNull(), "decision_id": F.coalesce("decision_id", made)})
    before = F.lag("decision_id").over(Window.partitionBy("target_id").orderBy("seq"))
    return named.withColumns({"supersedes": F.when(F.col("legacy"), before).otherwise(F.col("supersedes")), "orphan": ~F.col("snapshot").eqNullSafe(snapshot)})


def project(decisions: DataFrame) -> DataFrame:
    """(target_id, entries, tips, conflict, tip_id): the entry that no other supersedes; any other number is a conflict."""
    own = decisions.where(~F.col("orphan")) if "orphan" in decisions.columns else decisions
    gone = own.where("supersedes IS NOT NULL").select("target_id", F.col("supersedes").alias("decision_id")).distinct()
    marked = own.join(gone.withColumn("gone", F.lit(True)), ["target_id", "decision_id"], "left")
    open_ = F.col("gone").isNull()
    out = marked.groupBy("target_id").agg(F.count("*").alias("entries"), F.count_if(open_).alias("tips"), F.max(F.when(open_, F.col("decision_id"))).alias("tip"))
    return out.select("target_id", "entries", "tips", (F.col("tips") != 1).alias("conflict"), F.when(F.col("tips") == 1, F.col("tip")).alias("tip_id"))


def chain_faults(decisions: DataFrame) -> DataFrame:
    """(kind, decision_id): dangling, cross-slot and forward supersedes, duplicate ids; of a duplicate id the first counts."""
    d = decisions.select("decision_id", "target_id", "seq", "supersedes")
    earlier = d.groupBy(F.col("decision_id").alias("supersedes")).agg(F.min("target_id").alias("of"), F.min("seq").alias("of_seq"))
    linked = d.where("supersedes IS NOT NULL").join(earlier, "supersedes", "left")
    kind = F.when(F.col("of").isNull(), "dangling").when(F.col("of") != F.col("target_id"), "cross_slot").when(F.col("of_seq") >= F.col("seq"), "forward")
    twice = d.groupBy("decision_id").count().where("count > 1").select(F.lit("duplicate_id").alias("kind"), "decision_id")
    return linked.select(kind.alias("kind"), "decision_id").where("kind IS NOT NULL").union(twice)


def hash_chain(rows: DataFrame) -> DataFrame:
    """(chain_id, entries, broken): how often a record's previous digest is not the digest of the record before it, or its
    number is not its place from 0. A chain may lie in many tasks; ties of a number go by digest."""
    linked = ordered.carried(rows.select("chain_id", "seq", "digest", "previous", F.lit(1).alias("one")), "chain_id", ["seq", "digest"], ["one"], "digest")
    fault = ~F.col("previous").eqNullSafe(F.col("before")) | ~F.col("seq").eqNullSafe(F.col("before_one"))
    return linked.withColumn("fault", fault).groupBy("chain_id").agg(F.count("*").alias("entries"), F.count_if("fault").alias("broken"))


def _gaps(entries: DataFrame, by: str, *keep: str) -> DataFrame:
    """The entries' columns ``keep`` and ``gap``: microseconds since the entry before of the same ``by``."""
    at = F.unix_micros(F.col("decided_at").cast("timestamp"))
    rows = ordered.carried(entries.select(*dict.fromkeys((by, *keep)), "seq", at.alias("__at")), by, ["__at", "seq"], value="__at")
    return rows.withColumn("gap", F.col("__at") - F.col("before"))


def working_time(decisions: DataFrame, by: str) -> DataFrame:
    """(by, seconds, intervals, excluded): gaps to the entry before, kept from 0 to an hour."""
    rows, kept = _gaps(decisions, by), F.col("gap").between(0, GAP_SECONDS * 1_000_000)
    return rows.groupBy(by).agg(F.coalesce(F.sum(F.when(kept, F.col("gap"))), F.lit(0)).alias("micros"), F.count_if(kept).alias("intervals"), F.count_if(F.col("gap").isNotNull() & ~kept).alias("excluded"))


#: Columns of a new entry that may be left out, and their types.
OPTIONAL = {"reason_code": "string", "reviewer_confidence": "string", "suggestion_seen": "string", "supersedes": "string", "doc_id": "long", "field": "string", "target_id": "string"}


def validate(entries: DataFrame, docs: DataFrame | None = None, claims: DataFrame | None = None, tips: DataFrame | None = None) -> DataFrame:
    """The new entries with ``refused``: the first rule that each breaks, or null.

    Entries have decision, corrected_value, claim_id, rationale, decided_at (a time or ISO text) and columns of
    ``OPTIONAL``. Rules about a document, a claim or an existing tip apply where their tables are given: ``docs``
    (doc_id), ``claims`` (claim_id, doc_id, field), ``tips`` (target_id, tip_id, conflict) as ``project`` gives them.
    """
    rows = entries.select("*", *[F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items() if c not in entries.columns])
    d, value, code, claim = F.col("decision"), V.blank_to_null(F.col("corrected_value")), F.col("reason_code"), F.col("claim_id")
    unlike = reduce(lambda a, b: a | b, [(code == c) & ~F.coalesce(d.isin(*allowed), F.lit(False)) for c, allowed in CODE_DECISIONS.items()])
    time = F.try_to_timestamp(F.col("decided_at").cast("string"))
    rules = [
        (code.isNotNull() & ~code.isin(*REASON_CODES), "unknown_reason_code"), (unlike, "reason_code_of_other_decision"), (~F.col("reviewer_confidence").isin(*CONFIDENCES), "unknown_confidence"),
        (~F.col("suggestion_seen").rlike(SEEN), "malformed_suggestion"), (d.isNull() | ~d.isin(*DECISIONS), "unknown_decision"), (F.coalesce(F.trim("rationale"), F.lit("")) == "", "no_rationale"),
        ((d == "correct") & value.isNull(), "correction_without_value"), ((d != "correct") & F.col("corrected_value").isNotNull(), "value_without_correction"),
        ((d == "accept") & claim.isNull(), "accept_without_claim"), (d.isin("confirm_absent", "not_applicable") & claim.isNotNull(), "absent_with_claim"),
        (~F.col("field").isin(*V.NAMES), "unknown_field"), (F.col("decided_at").isNull() | (F.trim(F.col("decided_at").cast("string")) == ""), "no_time"), (time.isNull(), "time_not_iso"),
    ]
    if docs is not None:
        rows = rows.join(docs.select("doc_id", F.lit(True).alias("__doc")).distinct(), "doc_id", "left")
        rules.append((F.col("__doc").isNull(), "document_of_other_run"))
    if claims is not None:
        rows = rows.join(claims.select("claim_id", F.col("doc_id").alias("__cdoc"), F.col("field").alias("__cfield")), "claim_id", "left")
        rules.append((claim.isNotNull() & F.col("__cdoc").isNull(), "claim_missing"))
        rules.append((claim.isNotNull() & ((F.col("__cdoc") != F.col("doc_id")) | (F.col("__cfield") != F.col("field"))), "claim_of_other_slot"))
    if tips is not None:
        rows = rows.join(tips.select("target_id", F.col("tip_id").alias("__tip"), F.col("conflict").alias("__conflict")), "target_id", "left")
        rules += [(F.coalesce("__conflict", F.lit(False)), "chain_in_conflict"), (~F.col("supersedes").eqNullSafe(F.col("__tip")), "not_the_current_tip")]
    reason = reduce(lambda out, rule: out.when(*rule), rules[1:], F.when(*rules[0]))
    return rows.select(*entries.columns, reason.alias("refused"))


def reviewer_timing(entries: DataFrame, by: str, kind: str) -> DataFrame:
    """(kind, timed, median_micros): how long entries took, from the one before of the same ``by``, gaps above an hour left out."""
    rows = _gaps(entries, by, kind).where(F.col("gap").between(0, GAP_SECONDS * 1_000_000))
    middle = ordered.quantiles(rows, kind, "gap", {"median": 0.5})
    return middle.select(kind, F.col("n").alias("timed"), F.round("median").cast("long").alias("median_micros"))


def adoption(entries: DataFrame, claims: DataFrame) -> DataFrame:
    """The entries that saw a suggestion, with its ``state``, the value ``suggested`` and whether they ``adopted`` it:
    accepted a claim or wrote a correction that equals it after normalising. Null where the sources did not agree.

    Entries have decision_id, field, decision, claim_id, corrected_value, suggestion_seen; claims claim_id, value.
    """
    seen = F.col("suggestion_seen")
    rows = entries.where(seen.isNotNull() & (seen != "")).join(claims.select("claim_id", F.col("value").alias("__claimed")), "claim_id", "left")
    state, suggested = F.split_part(seen, F.lit(":"), F.lit(1)), F.regexp_extract(seen, r"(?s)^[^:]*:(.*)$", 1)
    final = F.when(F.col("decision") == "accept", F.col("__claimed")).when(F.col("decision") == "correct", F.col("corrected_value"))
    same = V.normalised(F.col("field"), final).eqNullSafe(V.normalised(F.col("field"), suggested)) & final.isNotNull()
    agree = state == "agree"
    return rows.select("decision_id", "field", "decision", state.alias("state"), F.when(agree, suggested).alias("suggested"), final.alias("final"), F.when(agree, same).alias("adopted"))


def review_report(slots: DataFrame, tips: DataFrame) -> DataFrame:
    """(decision, slots): how many slots have each decision, ``undecided`` for none. ``tips`` has doc_id, field, decision."""
    rows = slots.select("doc_id", "field").join(tips.select("doc_id", "field", "decision"), ["doc_id", "field"], "left")
    return rows.groupBy(F.coalesce("decision", F.lit("undecided")).alias("decision")).agg(F.count("*").alias("slots"))


def corrections(slots: DataFrame, tips: DataFrame) -> DataFrame:
    """(doc_id, field, old, new, rationale) of the slots whose tip corrects their value."""
    made = tips.where("decision = 'correct'").select("doc_id", "field", F.col("corrected_value").alias("new"), "rationale")
    return slots.select("doc_id", "field", F.col("value").alias("old")).join(made, ["doc_id", "field"]).select("doc_id", "field", "old", "new", "rationale")


def deliver(routed: DataFrame, tips: DataFrame, tier1_explicit: bool = True) -> DataFrame:
    """The status of each slot: of its tip's decision, or else of its route. ``tips`` has doc_id, field, decision."""
    decided = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("decision")]
    by_route = (
        F.when(F.col("route") == "auto_absent", "policy_confirmed_absent").when(F.col("route") != "auto_accept", "pending")
        .when(F.lit(not tier1_explicit), "policy_accepted").when(F.col("tier") == "TIER1", "pending_tier1").otherwise("unreviewed_corroborated")
    )
    return routed.join(tips, ["doc_id", "field"], "left").withColumn("status", F.coalesce(decided, by_route))


def blocks_posting(field: Column, status: Column, profile: str | None = None) -> Column:
    """Whether a slot's status keeps its document from being posted: without a profile any open one, else those of its fields."""
    if profile is None:
        return status.isin(*BLOCKING_ALL)
    return field.isin(*PROFILES[profile]) & status.isin(*BLOCKING_PROFILE)


def reject_blocks(field: Column, tier: Column, profile: str | None = None) -> Column:
    """Whether a rejected slot blocks its document: without a profile one of the first tier, else any of its fields."""
    return tier == "TIER1" if profile is None else field.isin(*PROFILES[profile])


def documents(delivered: DataFrame, profile: str | None = None) -> DataFrame:
    """(doc_id, status, pending, caveats, policy_disposed, tier1_policy_disposed): blocked by a rejected slot, pending, or
    ready; a ready one whose page text or responses were missing is ready with caveats, which are named."""
    tier, status, name = F.col("tier"), F.col("status"), F.col("field")
    policy = status.isin(*POLICY_STATUS)
    mask, named = V.field_bits, lambda m: F.array_join(V.fields_of(m), "+")
    flags = [c for c in ("ocr_missing", "first_missing", "second_missing") if c in delivered.columns]
    rows = delivered.groupBy("doc_id").agg(
        F.bool_or(reject_blocks(name, tier, profile) & (status == "rejected")).alias("rejected"), F.bool_or(blocks_posting(name, status, profile)).alias("open"),
        F.count_if(status.isin("pending", "pending_tier1")).alias("pending"), mask(policy).alias("policy_disposed"), mask(policy & (tier == "TIER1")).alias("tier1_policy_disposed"),
        *[F.bool_or(c).alias(c) for c in flags],
    )
    caveats = F.array_join(F.array_compact(F.array(*[F.when(F.col(c), c) for c in flags] or [F.lit(None).cast("string")])), "+")
    ready = F.when(caveats != "", "ready_for_approval_with_caveats").otherwise("ready_for_approval")
    state = F.when(F.col("rejected"), "blocked").when(F.col("open"), "pending").otherwise(ready)
    return rows.select("doc_id", state.alias("status"), "pending", caveats.alias("caveats"), *[named(c).alias(c) for c in ("policy_disposed", "tier1_policy_disposed")])


def approvals_state(docs: DataFrame, approvals: DataFrame) -> DataFrame:
    """The latest approval of each document, stale if the digest it signed is not today's or the document is not ready;
    an approved document keeps its caveats."""
    latest = approvals.groupBy("doc_id").agg(F.max_by("digest", "seq").alias("signed"), F.max("seq").alias("seq"))
    stale = (F.col("signed") != F.col("digest")) | ~F.col("status").startswith("ready_for_approval")
    approved = F.regexp_replace("status", "^ready_for_approval", "approved_for_export")
    return docs.join(latest, "doc_id").select("doc_id", "seq", stale.alias("stale"), F.when(~stale, approved).otherwise(F.col("status")).alias("status"))


def carry(prior: DataFrame, slots: DataFrame) -> DataFrame:
    """(target, outcome) for each slot of a new run: whether the decision of an earlier run holds for it.

    ``prior`` has target, run, seq, decision, rationale and the slot as it was then: value, spans, raw; the last entry of
    the latest run counts. ``slots`` has target, route, reasons, value (null: no claim), spans, raw. A probe is always
    looked at anew. Accepting and rejecting hold for the same claim with the same spans, a correction for the same raw
    value, an absence where there still is no claim.
    """
    last = prior.groupBy("target").agg(F.max_by(F.struct("decision", "rationale", "value", "spans", "raw"), F.struct("run", "seq")).alias("o")).select("target", "o")
    rows = slots.join(last, "target", "left")
    was = lambda c: F.col(f"o.{c}")
    d, some = was("decision"), lambda c: F.coalesce(c, F.array().cast("array<string>"))
    same = was("value").isNotNull() & F.col("value").isNotNull() & (was("value") == F.col("value")) & (F.sort_array(some(was("spans"))) == F.sort_array(some(F.col("spans"))))
    holds = (
        F.when(d.isin("accept", "reject"), same).when(d == "correct", was("raw").eqNullSafe(F.col("raw"))).when(d.isin("confirm_absent", "not_applicable"), F.col("value").isNull()).otherwise(False)
    )
    probe = F.exists("reasons", lambda r: r.startswith("QA_SAMPLE:"))
    outcome = (
        F.when(F.col("route").isin("auto_accept", "auto_absent"), "skipped_auto").when(probe, "kept_qa_fresh").when(F.col("o").isNull(), "no_prior")
        .when(~F.coalesce(holds, F.lit(False)), "skipped_changed").when(F.coalesce(F.trim(was("rationale")), F.lit("")) == "", "skipped_no_rationale").otherwise("carried")
    )
    return rows.select("target", outcome.alias("outcome"))


def claim_faults(entries: DataFrame, claims: DataFrame) -> DataFrame:
    """(kind, doc_id, field, claim_id) of entries whose claim does not exist or belongs to another slot."""
    own = claims.select("claim_id", F.col("doc_id").alias("__doc"), F.col("field").alias("__field"))
    kind = F.when(F.col("__doc").isNull(), "claim_missing").when((F.col("__doc") != F.col("doc_id")) | (F.col("__field") != F.col("field")), "claim_of_other_slot")
    return entries.where("claim_id IS NOT NULL").join(own, "claim_id", "left").select(kind.alias("kind"), "doc_id", "field", "claim_id").where("kind IS NOT NULL")


def projection_faults(delivered: DataFrame, claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """(kind, doc_id, field): all faults of each delivered slot against the ledgers that it is projected from.

    ``delivered`` has doc_id, field, status, value, source (the decision's id, or ``policy:`` and a rule) and claim_id of
    the slot table's row; ``claims`` claim_id, doc_id, field, value and ``primary`` (whether the first extractor drafted
    it); ``decisions`` decision_id, claim_id, corrected_value. A slot has one primary claim at most.
    """
    of_row = claims.select("claim_id", F.col("value").alias("__row"), F.lit(True).alias("__row_is"))
    decided = decisions.select(F.col("decision_id").alias("source"), F.col("claim_id").alias("__chosen"), F.col("corrected_value").alias("__new"), F.lit(True).alias("__decision"))
    chosen = claims.select(F.col("claim_id").alias("__chosen"), F.col("value").alias("__claimed"), F.lit(True).alias("__chosen_is"))
    first = claims.where("primary").select("doc_id", "field", F.col("value").alias("__first"), F.lit(True).alias("__first_is"))
    rows = delivered.join(of_row, "claim_id", "left").join(decided, "source", "left").join(chosen, "__chosen", "left").join(first, ["doc_id", "field"], "left")
    value, status, has, not_same = F.col("value"), F.col("status"), lambda c: F.col(c).isNotNull(), lambda c: ~F.col("value").eqNullSafe(F.col(c))
    rules = {
        "row_not_of_claim": has("__row_is") & not_same("__row"),
        "accepted_without_claim": (status == "accepted") & ~has("__chosen_is"),
        "accepted_not_of_claim": (status == "accepted") & has("__chosen_is") & not_same("__claimed"),
        "corrected_not_of_decision": (status == "corrected") & (~has("__decision") | not_same("__new")),
        "value_where_none_may_be": status.isin("rejected", "confirmed_absent", "not_applicable", "abstained") & value.isNotNull(),
        "absence_not_of_policy": (status == "policy_confirmed_absent") & (value.isNotNull() | ~F.coalesce(F.col("source").startswith("policy:"), F.lit(False))),
        "release_not_of_claim": status.isin("policy_accepted", "unreviewed_corroborated") & (~has("__first_is") | not_same("__first")),
        "accepted_unbound": status == "accepted_unbound",
    }
    found = F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))
    return rows.select(F.explode(found).alias("kind"), "doc_id", "field")


def feedback(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """The entries of this snapshot with the flags that decide whether they count for mining.

    ``entries`` as ``repair`` gives them, and with ``wellfounded``; ``probes`` (decision_id and, where they are known,
    target_id and seq) were drawn at random. An id made from 32 bits of content is another entry's too now and then, in a
    ledger of millions: a probe with its slot and number is that one entry.
    """
    own = entries.where("NOT orphan")
    gone = own.where("supersedes IS NOT NULL").select("target_id", F.col("supersedes").alias("decision_id"), F.lit(True).alias("__gone")).distinct()
    of = [c for c in ("target_id", "seq", "decision_id") if c in probes.columns]
    drawn = probes.select(*of, F.lit(True).alias("__drawn")).distinct()
    rows = own.join(gone, ["target_id", "decision_id"], "left").join(drawn, of, "left")
    rows = rows.withColumns({"superseded": F.col("__gone").isNotNull(), "actionable": (F.col("decision") != "abstain") & F.col("wellfounded"), "random_qa": F.col("__drawn").isNotNull()}).drop("__gone", "__drawn")
    return rows.withColumn("qualified", F.col("actionable") & ~F.col("superseded") & ~F.col("random_qa"))


def mine_cohorts(events: DataFrame, *by: str, least: int = 3) -> DataFrame:
    """Decisions by cohort; one that never needed a change is of low yield, one nearly always absent a candidate rule."""
    act = lambda *names: F.count_if(F.col("decision").isin(*names))
    n = F.count("*")
    return events.groupBy(*by).agg(
        n.alias("reviewed"), act("accept").alias("accepted"), act("correct").alias("corrected"), act("reject").alias("rejected"),
        ((n >= least) & (act("correct", "reject") == 0)).alias("low_yield"), ((n >= least) & (act("confirm_absent") >= 0.8 * n)).alias("absence_candidate"),
    )
