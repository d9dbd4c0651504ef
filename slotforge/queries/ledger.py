"""Queries over decision ledgers: events as decisions, conversations as chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotforge.functions import values as V
from slotforge.operators import ledger, ordered, routing, tables
from slotforge.queries import base, query
from slotforge.queries.base import table
from slotforge.queries.slots import POLICIES, routable, routed_sql

KINDS = {"signup": "accept", "purchase": "correct", "error": "reject", "view": "confirm_absent", "click": "abstain"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"
DEC = f"""dec AS (SELECT event_id seq, 'T' || event_id % 700 target_id, CASE WHEN event_id % 9 <> 0 THEN 'D' || event_id END decision_id, {_CASE} decision, user_id reviewer, ts decided_at,
 CASE WHEN event_id % 50 = 0 THEN 'S0' ELSE 'S1' END snapshot, CASE WHEN event_id % 9 <> 0 AND event_id % 4 <> 0 THEN 'D' || (event_id - 700) END supersedes0, event_id FROM events),
rep AS (SELECT *, coalesce(decision_id, 'legacy-' || substr(sha256(target_id || '|' || seq || '|' || decision), 1, 8)) did, decision_id IS NULL legacy, snapshot <> 'S1' orphan FROM dec),
rep2 AS (SELECT *, CASE WHEN legacy THEN lag(did) OVER (PARTITION BY target_id ORDER BY seq) ELSE supersedes0 END supersedes FROM rep)"""


def decisions(spark, d):
    """Each event as an entry on one of 700 slots; some lack ids, some belong to another snapshot, some break chains."""
    e, i = table(spark, d, "events"), F.col("event_id")
    named = i % 9 != 0
    return e.select(
        i.alias("seq"), F.concat(F.lit("T"), (i % 700).cast("string")).alias("target_id"), F.when(named, F.concat(F.lit("D"), i.cast("string"))).alias("decision_id"),
        F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")].alias("decision"), F.col("user_id").alias("reviewer"), F.col("ts").alias("decided_at"),
        F.when(i % 50 == 0, "S0").otherwise("S1").alias("snapshot"), F.when(named & (i % 4 != 0), F.concat(F.lit("D"), (i - 700).cast("string"))).alias("supersedes"),
    )


def repaired(spark, d):
    return ledger.repair(decisions(spark, d), F.lit("S1"))


@query("s7_ledger_repair", f"WITH {DEC} SELECT seq, did AS decision_id, supersedes, orphan FROM rep2")
def s7(spark, d):
    return repaired(spark, d).select("seq", "decision_id", "supersedes", "orphan")


_TIPS = DEC + """, own AS (SELECT * FROM rep2 WHERE NOT orphan), gone AS (SELECT DISTINCT target_id, supersedes did FROM own WHERE supersedes IS NOT NULL),
mk AS (SELECT own.*, gone.did IS NULL open_ FROM own LEFT JOIN gone USING (target_id, did)),
proj AS (SELECT target_id, count(*) entries, count_if(open_) tips, max(CASE WHEN open_ THEN did END) tip FROM mk GROUP BY 1)"""


@query("v2_supersession_tips", f"WITH {_TIPS} SELECT target_id, entries, tips, tips <> 1 AS conflict, CASE WHEN tips = 1 THEN tip END AS tip_id FROM proj")
def v2(spark, d):
    return ledger.project(repaired(spark, d))


@query("v17_chain_faults", f"""WITH {DEC}, w AS (SELECT target_id, seq, CASE WHEN seq % 97 = 3 THEN 'D' || (seq - 700) ELSE did END did, CASE seq % 97 WHEN 1 THEN 'D' || (seq - 1) WHEN 2 THEN 'D' || (seq + 700) ELSE supersedes END supersedes FROM rep2),
one AS (SELECT did, min(target_id) of_, min(seq) of_seq, count(*) n FROM w GROUP BY 1), l AS (SELECT w.did, w.target_id, w.seq, of_, of_seq FROM w LEFT JOIN one ON one.did = w.supersedes WHERE w.supersedes IS NOT NULL)
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN of_ IS NULL THEN 'dangling' WHEN of_ <> target_id THEN 'cross_slot' WHEN of_seq >= seq THEN 'forward' END kind FROM l
 UNION ALL SELECT 'duplicate_id' FROM one WHERE n > 1) WHERE kind IS NOT NULL GROUP BY 1""")
def v17(spark, d):
    """The ledger with entries that name another slot's, a later one, or an id that was given before."""
    seq, named = F.col("seq"), lambda n: F.concat(F.lit("D"), (F.col("seq") + n).cast("string"))
    rows = repaired(spark, d).withColumns({
        "decision_id": F.when(seq % 97 == 3, named(-700)).otherwise(F.col("decision_id")), "supersedes": F.when(seq % 97 == 1, named(-1)).when(seq % 97 == 2, named(700)).otherwise(F.col("supersedes")),
    })
    return ledger.chain_faults(rows).groupBy("kind").agg(F.count("*").alias("n"))


@query("v16_hash_chains", """WITH c AS (SELECT conv_id chain_id, turn seq, sha256(conv_id || '|' || turn || '|' || coalesce(text, '')) digest FROM conversations),
p AS (SELECT *, CASE WHEN (chain_id + seq) % 11 = 0 THEN 'x' ELSE lag(digest) OVER (PARTITION BY chain_id ORDER BY seq) END previous FROM c),
f AS (SELECT chain_id, previous IS DISTINCT FROM lag(digest) OVER w OR seq <> row_number() OVER w - 1 fault FROM p WINDOW w AS (PARTITION BY chain_id ORDER BY seq))
SELECT chain_id, count(*) AS entries, count_if(fault) AS broken FROM f GROUP BY 1""")
def v16(spark, d):
    """Turns as chained records; one in eleven names a wrong predecessor."""
    digest = F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.coalesce("text", F.lit(""))), 256)
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("chain_id"), F.col("turn").alias("seq"), digest.alias("digest"))
    linked = ordered.carried(c, "chain_id", ["seq"], value="digest")
    return ledger.hash_chain(linked.withColumn("previous", F.when((F.col("chain_id") + F.col("seq")) % 11 == 0, "x").otherwise(F.col("before"))))


_WORK = """g AS (SELECT user_id reviewer, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) gap FROM events)"""


@query("v1_a27_working_time", f"""WITH {_WORK}, t AS (SELECT reviewer, CAST(coalesce(sum(gap) FILTER (WHERE gap BETWEEN 0 AND 3600000000), 0) AS BIGINT) micros, count_if(gap BETWEEN 0 AND 3600000000) intervals,
 count_if(gap NOT BETWEEN 0 AND 3600000000) excluded FROM g GROUP BY 1) SELECT reviewer, micros, intervals, excluded, greatest(7200000000 - micros, 0) AS remaining, micros >= 7200000000 AS exhausted FROM t""")
def v1(spark, d):
    """Working time of each reviewer against a budget of two hours."""
    used = ledger.working_time(table(spark, d, "events").select(F.col("user_id").alias("reviewer"), F.col("ts").alias("decided_at"), F.col("event_id").alias("seq")), "reviewer")
    budget = 7_200_000_000
    return used.withColumns({"remaining": F.greatest(budget - F.col("micros"), F.lit(0)).cast("long"), "exhausted": F.col("micros") >= budget})


@query("a25_reviewer_timing", """WITH g AS (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) gap FROM events)
SELECT event_type, count(*) AS timed, CAST(round(quantile_cont(gap, 0.5)) AS BIGINT) AS median_micros FROM g WHERE gap BETWEEN 0 AND 3600000000 GROUP BY 1""")
def a25(spark, d):
    """How long entries of each kind took; gaps above an hour are rests."""
    rows = table(spark, d, "events").select("event_type", "user_id", F.col("ts").alias("decided_at"), F.col("event_id").alias("seq"))
    return ledger.reviewer_timing(rows, "user_id", "event_type")


_NEW = f"""nw AS (SELECT *, seq % 3000 doc_id, (['invoice_number', 'total_gross', 'colour', 'seller_name'])[seq % 4 + 1] field, CASE WHEN seq % 3 = 0 OR decision = 'correct' AND seq % 19 <> 0 THEN 'v' END cv,
 CASE WHEN seq % 5 <> 0 THEN seq % 3000 * 100 + seq % 4 + CAST(seq % 31 = 0 AS INT) END claim, CASE WHEN seq % 7 <> 0 THEN 'r' ELSE ' ' END why,
 CASE seq % 23 WHEN 1 THEN 'WRONG_VALUE' WHEN 2 THEN 'CONFIRMED_ABSENT' WHEN 3 THEN 'GUESS' WHEN 4 THEN 'OTHER' END code, CASE seq % 29 WHEN 1 THEN 'sure' WHEN 2 THEN 'high' END conf,
 CASE seq % 37 WHEN 1 THEN 'agree:' WHEN 2 THEN 'blind' WHEN 3 THEN 'agree:x' END seen, CASE WHEN seq % 41 = 0 THEN 'next week' WHEN seq % 43 <> 0 THEN '2024-01-05T10:00:00' END said,
 CASE WHEN seq % 6 = 0 THEN 'T' || seq % 700 ELSE 'N' || seq END target, CASE WHEN seq % 6 = 0 AND seq % 12 = 0 THEN 'D1' END sup FROM dec),
cl AS (SELECT DISTINCT event_id % 3000 * 100 + f claim, event_id % 3000 c_doc, (['invoice_number', 'total_gross', 'colour', 'seller_name'])[f + 1] c_field FROM events, range(4) r(f) WHERE event_id % 3000 % 13 <> 0)"""


@query("r7_decision_validation", f"""WITH {{_T}}, {_NEW}
SELECT CASE WHEN code = 'GUESS' THEN 'unknown_reason_code' WHEN (code = 'WRONG_VALUE' AND decision NOT IN ('correct', 'reject')) OR (code = 'CONFIRMED_ABSENT' AND decision <> 'confirm_absent') THEN 'reason_code_of_other_decision'
 WHEN conf = 'sure' THEN 'unknown_confidence' WHEN seen = 'agree:' THEN 'malformed_suggestion' WHEN trim(why) = '' THEN 'no_rationale' WHEN decision = 'correct' AND cv IS NULL THEN 'correction_without_value'
 WHEN decision <> 'correct' AND cv IS NOT NULL THEN 'value_without_correction' WHEN decision = 'accept' AND claim IS NULL THEN 'accept_without_claim' WHEN decision = 'confirm_absent' AND claim IS NOT NULL THEN 'absent_with_claim'
 WHEN field = 'colour' THEN 'unknown_field' WHEN said IS NULL THEN 'no_time' WHEN said = 'next week' THEN 'time_not_iso' WHEN doc_id % 17 = 0 THEN 'document_of_other_run' WHEN claim IS NOT NULL AND c_doc IS NULL THEN 'claim_missing'
 WHEN claim IS NOT NULL AND (c_doc <> doc_id OR c_field <> field) THEN 'claim_of_other_slot' WHEN coalesce(tips <> 1, false) THEN 'chain_in_conflict' WHEN sup IS DISTINCT FROM CASE WHEN tips = 1 THEN tip END THEN 'not_the_current_tip' END AS refused, count(*) AS n
FROM nw LEFT JOIN cl USING (claim) LEFT JOIN proj ON proj.target_id = nw.target GROUP BY 1""".replace("{_T}", _TIPS))
def r7(spark, d):
    """New entries against the documents, claims and tips that there are."""
    s = F.col("seq")
    at = lambda values, i: F.get(F.array(*[F.lit(v).cast("string") for v in values]), i.cast("int"))
    doc = s % 3000
    rows = decisions(spark, d).drop("target_id", "supersedes", "decided_at").withColumns({
        "doc_id": doc, "field": at(["invoice_number", "total_gross", "colour", "seller_name"], s % 4), "corrected_value": F.when((s % 3 == 0) | ((F.col("decision") == "correct") & (s % 19 != 0)), "v"),
        "claim_id": F.when(s % 5 != 0, doc * 100 + s % 4 + (s % 31 == 0).cast("int")), "rationale": F.when(s % 7 != 0, "r").otherwise(" "), "reason_code": at([None, "WRONG_VALUE", "CONFIRMED_ABSENT", "GUESS", "OTHER"], s % 23),
        "reviewer_confidence": at([None, "sure", "high"], s % 29), "suggestion_seen": at([None, "agree:", "blind", "agree:x"], s % 37), "decided_at": F.when(s % 41 == 0, "next week").when(s % 43 != 0, "2024-01-05T10:00:00"),
        "target_id": F.when(s % 6 == 0, F.concat(F.lit("T"), (s % 700).cast("string"))).otherwise(F.concat(F.lit("N"), s.cast("string"))), "supersedes": F.when(s % 12 == 0, "D1"),
    })
    docs = rows.select("doc_id").distinct().where("doc_id % 17 <> 0")
    claims = rows.select("doc_id").distinct().where("doc_id % 13 <> 0").select("doc_id", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("f"))
    claims = claims.select((F.col("doc_id") * 100 + F.col("f")).alias("claim_id"), "doc_id", at(["invoice_number", "total_gross", "colour", "seller_name"], F.col("f")).alias("field"))
    return ledger.validate(rows, docs, claims, ledger.project(repaired(spark, d))).groupBy("refused").agg(F.count("*").alias("n"))


def tips(spark, d):
    """The last event of each (document, field) as its tip."""
    rows = decisions(spark, d).select(F.col("seq"), "decision", (F.col("seq") % 3000).alias("doc_id"), F.get(F.array(*[F.lit(n) for n in V.NAMES]), (F.floor(F.col("seq") / 3000) % 10).cast("int")).alias("field"))
    return rows.groupBy("doc_id", "field").agg(F.max_by("decision", "seq").alias("decision"))


_NAMES = "[" + ", ".join(f"'{n}'" for n in V.NAMES) + "]"
_DELIVER = f"""tip AS (SELECT event_id % 3000 doc_id, ({_NAMES})[event_id // 3000 % 10 + 1] field, max_by({_CASE}, event_id) decision FROM events GROUP BY 1, 2),
dl AS (SELECT r.doc_id, r.field, r.tier, array_to_string(list_filter([CASE WHEN r.doc_id % 97 = 0 THEN 'ocr_missing' END, CASE WHEN r.doc_id % 41 = 0 THEN 'second_missing' END], lambda x: x IS NOT NULL), '+') cav, coalesce(CASE decision {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ledger.STATUS.items())} END,
 CASE WHEN route = 'auto_absent' THEN 'policy_confirmed_absent' WHEN route <> 'auto_accept' THEN 'pending' WHEN tier = 'TIER1' THEN 'pending_tier1' ELSE 'unreviewed_corroborated' END) status
 FROM routed r LEFT JOIN tip USING (doc_id, field) WHERE policy_id = 'P2'),
dd AS (SELECT doc_id, CASE WHEN bool_or(tier = 'TIER1' AND status = 'rejected') THEN 'blocked' WHEN bool_or(status IN ('pending', 'pending_tier1', 'abstained')) THEN 'pending' WHEN any_value(cav) <> '' THEN 'ready_for_approval_with_caveats' ELSE 'ready_for_approval' END status,
 CASE WHEN bool_or(field IN ('invoice_number', 'seller_name', 'amount_due') AND status = 'rejected') THEN 'blocked' WHEN bool_or(field IN ('invoice_number', 'seller_name', 'amount_due') AND status IN ('pending', 'abstained')) THEN 'pending' WHEN any_value(cav) <> '' THEN 'ready_for_approval_with_caveats' ELSE 'ready_for_approval' END profile_status,
 any_value(cav) caveats, coalesce(string_agg(field, '+' ORDER BY field) FILTER (WHERE tier = 'TIER1' AND status IN ('policy_accepted', 'policy_confirmed_absent', 'unreviewed_corroborated')), '') tier1_policy_disposed,
 count_if(status IN ('pending', 'pending_tier1')) pending, coalesce(string_agg(field, '+' ORDER BY field) FILTER (WHERE status IN ('policy_accepted', 'policy_confirmed_absent', 'unreviewed_corroborated')), '') policy_disposed FROM dl GROUP BY 1)"""


def delivered(spark, d):
    return ledger.deliver(routing.route(routable(spark, d), POLICIES[1], explain=False), tips(spark, d))


@query("r6_deliverable_slots", routed_sql("SELECT field, status, count(*) AS n FROM dl GROUP BY 1, 2", _DELIVER))
def r6(spark, d):
    return delivered(spark, d).groupBy("field", "status").agg(F.count("*").alias("n"))


@query("a5_f20_document_status", routed_sql("SELECT doc_id, status, pending, caveats, policy_disposed, tier1_policy_disposed FROM dd", _DELIVER))
def a5(spark, d):
    return ledger.documents(delivered(spark, d))


@query("f20_profile_status", routed_sql("SELECT profile_status AS status, caveats, count(*) AS docs FROM dd GROUP BY 1, 2", _DELIVER))
def f20(spark, d):
    """Documents by status where only the fields that a payment needs must be settled."""
    return ledger.documents(delivered(spark, d), "payment_required_v1").groupBy("status", "caveats").agg(F.count("*").alias("docs"))


@query("a6_workload", routed_sql("SELECT status, count(*) AS docs, CAST(sum(pending) AS BIGINT) AS pending, max(pending) AS most, quantile_disc(pending, 0.5) AS upper_median FROM dd GROUP BY 1", _DELIVER))
def a6(spark, d):
    return ledger.documents(delivered(spark, d)).groupBy("status").agg(
        F.count("*").alias("docs"), F.sum("pending").alias("pending"), F.max("pending").alias("most"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY pending)").alias("upper_median")
    )


@query("v14_r9_approvals", routed_sql("""SELECT doc_id, seq, signed <> digest OR NOT starts_with(status, 'ready_for_approval') AS stale, CASE WHEN signed = digest AND starts_with(status, 'ready_for_approval') THEN replace(status, 'ready_for_approval', 'approved_for_export') ELSE status END AS status
 FROM (SELECT *, sha256(status || '|' || policy_disposed) digest FROM dd) JOIN (SELECT doc_id, max(seq) seq, max_by(CASE WHEN seq % 2 = 0 THEN 'old' ELSE sha256('ready_for_approval|' || pd) END, seq) signed
 FROM (SELECT o_orderkey doc_id, o_custkey seq FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1 FROM orders WHERE o_orderkey % 2 = 0) JOIN (SELECT doc_id, policy_disposed pd FROM dd) USING (doc_id) GROUP BY 1) USING (doc_id)""", _DELIVER))
def v14(spark, d):
    """One or two approvals of each document, of which even ones signed another digest."""
    digest = lambda status: F.sha2(F.concat(status, F.lit("|"), F.col("policy_disposed")), 256)
    # written, as approvals and their state both read it: a row for each document
    docs = tables.cut(ledger.documents(delivered(spark, d)).select("doc_id", "status", "policy_disposed"))
    docs = docs.withColumn("digest", digest(F.col("status")))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("seq"))
    signed = o.union(o.where("doc_id % 2 = 0").select("doc_id", F.col("seq") + 1))
    approvals = signed.join(docs, "doc_id").select("doc_id", "seq", F.when(F.col("seq") % 2 == 0, "old").otherwise(digest(F.lit("ready_for_approval"))).alias("digest"))
    return ledger.approvals_state(docs, approvals)


@query("j13_carry_over", """WITH o AS (SELECT o_custkey target, max_by({'d': CASE o_orderkey % 6 WHEN 0 THEN 'accept' WHEN 1 THEN 'correct' WHEN 2 THEN 'confirm_absent' WHEN 3 THEN 'reject' WHEN 4 THEN 'not_applicable' ELSE 'abstain' END,
 'v': CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 4 AS VARCHAR) END, 's': list_sort(['p' || o_orderkey % 3, 'q']), 'w': CAST(o_orderkey % 2 AS VARCHAR), 'r': CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE 'why' END}, (o_orderkey % 5) * 100000000 + o_orderkey) o FROM orders GROUP BY 1),
n AS (SELECT c_custkey target, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 4 AS VARCHAR) END now, list_sort(['q', 'p' || c_custkey % 3]) s, CAST(c_custkey % 2 AS VARCHAR) w,
 CASE c_custkey % 11 WHEN 0 THEN 'auto_accept' WHEN 1 THEN 'auto_absent' ELSE 'review' END route, c_custkey % 13 = 0 probe FROM customer)
SELECT CASE WHEN route LIKE 'auto%' THEN 'skipped_auto' WHEN probe THEN 'kept_qa_fresh' WHEN o IS NULL THEN 'no_prior'
 WHEN NOT coalesce(CASE WHEN o.d IN ('accept', 'reject') THEN o.v IS NOT NULL AND now IS NOT NULL AND o.v = now AND o.s = n.s WHEN o.d = 'correct' THEN o.w = n.w WHEN o.d IN ('confirm_absent', 'not_applicable') THEN now IS NULL ELSE false END, false) THEN 'skipped_changed'
 WHEN trim(o.r) = '' THEN 'skipped_no_rationale' ELSE 'carried' END AS outcome, count(*) AS n FROM n LEFT JOIN o USING (target) GROUP BY 1""")
def j13(spark, d):
    """Orders as entries of five earlier runs on a customer's slot; the latest run's last entry counts."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    s = lambda x: x.cast("string")
    old = table(spark, d, "orders").select(
        F.col("o_custkey").alias("target"), (k % 5).alias("run"), k.alias("seq"), F.get(F.array(*[F.lit(x) for x in ("accept", "correct", "confirm_absent", "reject", "not_applicable", "abstain")]), (k % 6).cast("int")).alias("decision"),
        F.when(k % 10 == 0, " ").otherwise("why").alias("rationale"), F.when(k % 7 != 0, s(k % 4)).alias("value"), F.array(F.concat(F.lit("p"), s(k % 3)), F.lit("q")).alias("spans"), s(k % 2).alias("raw"),
    )
    new = table(spark, d, "customer").select(
        c.alias("target"), F.when(c % 11 == 0, "auto_accept").when(c % 11 == 1, "auto_absent").otherwise("review").alias("route"), F.when(c % 13 == 0, F.array(F.lit("CLEAN"), F.lit("QA_SAMPLE:r"))).otherwise(F.array(F.lit("CLEAN"))).alias("reasons"),
        F.when(c % 5 != 0, s(c % 4)).alias("value"), F.array(F.lit("q"), F.concat(F.lit("p"), s(c % 3))).alias("spans"), s(c % 2).alias("raw"),
    )
    return ledger.carry(old, new).groupBy("outcome").agg(F.count("*").alias("n"))


@query("a13_feedback_events", f"""WITH {_TIPS} SELECT decision, count(*) AS events, count_if(NOT open_) AS superseded, count_if(decision <> 'abstain' AND seq % 6 <> 0) AS actionable, count_if(seq % 20 = 0) AS random_qa,
 count_if(open_ AND decision <> 'abstain' AND seq % 6 <> 0 AND seq % 20 <> 0) AS qualified FROM mk GROUP BY 1""")
def a13(spark, d):
    return feedback(spark, d).groupBy("decision").agg(
        F.count("*").alias("events"), F.count_if("superseded").alias("superseded"), F.count_if("actionable").alias("actionable"), F.count_if("random_qa").alias("random_qa"), F.count_if("qualified").alias("qualified")
    )


def feedback(spark, d):
    """Entries with the flags that decide whether they count for mining."""
    own = repaired(spark, d)
    return ledger.feedback(own.withColumn("wellfounded", F.col("seq") % 6 != 0), own.where("seq % 20 = 0").select("target_id", "seq", "decision_id"))


@query("a14_cohort_mining", f"""WITH {_TIPS} SELECT ({_NAMES})[seq % 10 + 1] AS field, reviewer % 3 AS route, count(*) AS reviewed, count_if(decision = 'accept') AS accepted, count_if(decision = 'correct') AS corrected,
 count_if(decision = 'reject') AS rejected, count(*) >= 3 AND count_if(decision IN ('correct', 'reject')) = 0 AS low_yield, count(*) >= 3 AND count_if(decision = 'confirm_absent') >= 0.8 * count(*) AS absence_candidate
 FROM mk WHERE open_ AND decision <> 'abstain' AND seq % 6 <> 0 AND seq % 20 <> 0 GROUP BY 1, 2""")
def a14(spark, d):
    rows = feedback(spark, d).where("qualified").withColumns({"field": F.get(F.array(*[F.lit(n) for n in V.NAMES]), (F.col("seq") % 10).cast("int")), "route": F.col("reviewer") % 3})
    return ledger.mine_cohorts(rows, "field", "route")


@query("j15_claim_integrity", """WITH d AS (SELECT l_orderkey doc_id, l_linenumber field, l_orderkey * 10 + l_linenumber - CAST(l_partkey % 40 = 0 AS INT) claim_id FROM lineitem),
c AS (SELECT l_orderkey * 10 + l_linenumber claim_id, l_orderkey c_doc, l_linenumber c_field FROM lineitem WHERE l_linenumber < 7)
SELECT CASE WHEN c_doc IS NULL THEN 'claim_missing' WHEN c_doc <> doc_id OR c_field <> field THEN 'claim_of_other_slot' END AS kind, count(*) AS n FROM d LEFT JOIN c USING (claim_id) GROUP BY 1 HAVING kind IS NOT NULL""")
def j15(spark, d):
    """Decisions whose claim does not exist or belongs to another slot."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("field"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("own"), "l_partkey")
    made = line.select("doc_id", "field", (F.col("own") - (F.col("l_partkey") % 40 == 0).cast("int")).alias("claim_id"))
    claims = line.where("field < 7").select(F.col("own").alias("claim_id"), "doc_id", "field")
    return ledger.claim_faults(made, claims).groupBy("kind").agg(F.count("*").alias("n"))


_KINDS16 = ("accepted", "corrected", "rejected", "confirmed_absent", "policy_confirmed_absent", "policy_accepted", "unreviewed_corroborated", "not_applicable", "accepted_unbound", "pending")
_VALUE16 = "CASE WHEN {k} IN ('rejected', 'confirmed_absent', 'policy_confirmed_absent', 'not_applicable') AND l_suppkey % 7 <> 0 THEN NULL WHEN l_suppkey % 11 = 0 THEN 'other' WHEN {k} = 'corrected' THEN 'new' || l_partkey ELSE 'v' || l_partkey END"


@query("j16_projection_check", f"""WITH k AS (SELECT *, ({list(_KINDS16)})[l_partkey % 10 + 1] status, l_orderkey * 10 + l_linenumber id FROM lineitem),
dl AS (SELECT l_orderkey doc_id, l_linenumber field, status, {_VALUE16.format(k="status")} AS value, CASE WHEN status IN ('accepted', 'corrected') THEN 'D' || id WHEN status LIKE 'policy%' AND l_suppkey % 5 <> 0 THEN 'policy:r' END source, CASE WHEN l_suppkey % 3 = 0 THEN id END claim_id FROM k),
cl AS (SELECT id claim_id, l_orderkey doc_id, l_linenumber field, CASE WHEN status = 'corrected' THEN 'new' || l_partkey ELSE 'v' || l_partkey END AS value FROM k WHERE l_suppkey % 13 <> 0),
de AS (SELECT 'D' || id decision_id, id claim_id, 'new' || l_partkey corrected_value FROM k WHERE l_suppkey % 17 <> 0),
j AS (SELECT dl.*, r.value rv, r.claim_id rc, d.decision_id di, d.corrected_value nv, c.claim_id cc, c.value cv, f.claim_id fc, f.value fv FROM dl LEFT JOIN cl r ON r.claim_id = dl.claim_id LEFT JOIN de d ON d.decision_id = dl.source LEFT JOIN cl c ON c.claim_id = d.claim_id LEFT JOIN cl f ON f.doc_id = dl.doc_id AND f.field = dl.field),
x AS (SELECT unnest([CASE WHEN rc IS NOT NULL AND value IS DISTINCT FROM rv THEN 'row_not_of_claim' END, CASE WHEN status = 'accepted' AND cc IS NULL THEN 'accepted_without_claim' END, CASE WHEN status = 'accepted' AND cc IS NOT NULL AND value IS DISTINCT FROM cv THEN 'accepted_not_of_claim' END,
 CASE WHEN status = 'corrected' AND (di IS NULL OR value IS DISTINCT FROM nv) THEN 'corrected_not_of_decision' END, CASE WHEN status IN ('rejected', 'confirmed_absent', 'not_applicable', 'abstained') AND value IS NOT NULL THEN 'value_where_none_may_be' END,
 CASE WHEN status = 'policy_confirmed_absent' AND (value IS NOT NULL OR source IS NULL OR source NOT LIKE 'policy:%') THEN 'absence_not_of_policy' END, CASE WHEN status IN ('policy_accepted', 'unreviewed_corroborated') AND (fc IS NULL OR value IS DISTINCT FROM fv) THEN 'release_not_of_claim' END,
 CASE WHEN status = 'accepted_unbound' THEN 'accepted_unbound' END]) kind FROM j)
SELECT kind, count(*) AS n FROM x WHERE kind IS NOT NULL GROUP BY 1""")
def j16(spark, d):
    """Lines as delivered slots of every status against claims and decisions, some of which are gone or say something else."""
    rows = table(spark, d, "lineitem").withColumns({
        "status": F.get(F.array(*[F.lit(k) for k in _KINDS16]), (F.col("l_partkey") % 10).cast("int")), "id": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "doc_id": F.col("l_orderkey"), "field": F.col("l_linenumber"),
    })
    policy = F.when(F.col("status").startswith("policy") & (F.col("l_suppkey") % 5 != 0), "policy:r")
    own = F.concat(F.lit("D"), F.col("id").cast("string"))
    delivered = rows.select("doc_id", "field", "status", F.expr(_VALUE16.format(k="status")).alias("value"), F.when(F.col("status").isin("accepted", "corrected"), own).otherwise(policy).alias("source"), F.when(F.col("l_suppkey") % 3 == 0, F.col("id")).alias("claim_id"))
    said = F.concat(F.when(F.col("status") == "corrected", "new").otherwise("v"), F.col("l_partkey").cast("string"))
    claims = rows.where("l_suppkey % 13 <> 0").select(F.col("id").alias("claim_id"), "doc_id", "field", said.alias("value"), F.lit(True).alias("primary"))
    made = rows.where("l_suppkey % 17 <> 0").select(own.alias("decision_id"), F.col("id").alias("claim_id"), F.concat(F.lit("new"), F.col("l_partkey").cast("string")).alias("corrected_value"))
    return ledger.projection_faults(delivered, claims, made).groupBy("kind").agg(F.count("*").alias("n"))


_SEEN = f"""en AS (SELECT event_id, ({_NAMES})[event_id % 10 + 1] field, {_CASE} decision, CASE WHEN event_id % 3 <> 0 THEN event_id - event_id % 2 END claim_id, CASE WHEN event_type = 'purchase' THEN event_id % 5 || '.50' END cv,
 CASE event_id % 8 WHEN 0 THEN 'split' WHEN 1 THEN 'blind' WHEN 2 THEN 'agree_rejected:7' WHEN 3 THEN NULL ELSE 'agree:' || event_id % 5 || '.5' END seen FROM events),
ad AS (SELECT *, string_split(seen, ':')[1] state, CASE WHEN decision = 'accept' THEN CASE WHEN claim_id % 2 = 0 THEN claim_id % 5 || '.5' END WHEN decision = 'correct' THEN cv END final, event_id % 5 || '.5' suggested FROM en WHERE seen IS NOT NULL)"""


def _adoptions(spark, d):
    """Events as entries on fields, most of which saw a suggestion; a claim is what every second event stands for."""
    e, i = table(spark, d, "events"), F.col("event_id")
    s = lambda x: x.cast("string")
    entries = e.select(
        i.alias("decision_id"), F.get(F.array(*[F.lit(n) for n in V.NAMES]), (i % 10).cast("int")).alias("field"), F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")].alias("decision"),
        F.when(i % 3 != 0, i - i % 2).alias("claim_id"), F.when(F.col("event_type") == "purchase", F.concat(s(i % 5), F.lit(".50"))).alias("corrected_value"),
        F.when(i % 8 == 0, "split").when(i % 8 == 1, "blind").when(i % 8 == 2, "agree_rejected:7").when(i % 8 != 3, F.concat(F.lit("agree:"), s(i % 5), F.lit(".5"))).alias("suggestion_seen"),
    )
    claims = e.where("event_id % 2 = 0").select(i.alias("claim_id"), F.concat(s(i % 5), F.lit(".5")).alias("value"))
    return ledger.adoption(entries, claims)


@query("a26_suggestion_adoption", f"""WITH {_SEEN}, nf AS (SELECT *, {base.norm_sql("field", "final")} nfinal, {base.norm_sql("field", "suggested")} nsug FROM ad)
SELECT state, count(*) AS n, count_if(state = 'agree' AND final IS NOT NULL AND nfinal IS NOT DISTINCT FROM nsug) AS adopted FROM nf GROUP BY 1""")
def a26(spark, d):
    return _adoptions(spark, d).groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.coalesce("adopted", F.lit(False))).alias("adopted"))


@query("a39_review_report", routed_sql("SELECT coalesce(decision, 'undecided') AS decision, count(*) AS slots FROM routed LEFT JOIN tip USING (doc_id, field) WHERE policy_id = 'P2' GROUP BY 1", _DELIVER))
def a39(spark, d):
    return ledger.review_report(base.slots(spark, d), tips(spark, d))


@query("a39_corrections", base.with_sql("m1", f"""SELECT doc_id, field, m1.value AS old, 'c' || seq AS "new", 'seen ' || seq AS rationale FROM m1 JOIN (SELECT doc_id, field, seq FROM lt WHERE decision = 'correct') USING (doc_id, field)""",
    f"lt AS (SELECT event_id % 3000 doc_id, ({_NAMES})[event_id // 3000 % 10 + 1] field, max(event_id) seq, max_by({_CASE}, event_id) decision FROM events GROUP BY 1, 2)"))
def a39_corrections(spark, d):
    """What reviewers changed, from what to what and why."""
    rows = decisions(spark, d).select("seq", "decision", (F.col("seq") % 3000).alias("doc_id"), F.get(F.array(*[F.lit(n) for n in V.NAMES]), (F.floor(F.col("seq") / 3000) % 10).cast("int")).alias("field"))
    last = rows.groupBy("doc_id", "field").agg(F.max_by("decision", "seq").alias("decision"), F.max("seq").cast("string").alias("s"))
    return ledger.corrections(base.long(base.wide(spark, d)), last.select("doc_id", "field", "decision", F.concat(F.lit("c"), "s").alias("corrected_value"), F.concat(F.lit("seen "), "s").alias("rationale")))
