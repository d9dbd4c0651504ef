"""Policy routing (ids R1, R2, R10, J10, V4, V10, A3 of the survey): slots crossed with a bounded table of policies."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotforge.functions import values as V
from slotforge.operators import gates, tables


@dataclass(frozen=True)
class Policy:
    """Rules as data. ``absent`` and ``evidenced`` hold (rule id, field[, class]); ``cohorts`` (rule id, field, tier, strength), None matching all.

    ``sampler`` 2 draws the same slots under every policy with the rule; 1, for replaying old runs, draws by policy.
    """

    policy_id: str
    seed: str = "qa"
    absent: tuple = ()
    evidenced: tuple = ()
    cohorts: tuple = ()
    rates: dict = field(default_factory=dict)
    tier1_explicit: bool = True
    sampler: int = 2


def qa_hit(policy: Policy, kind: str, identity: Column | str, doc: Column, name: Column) -> Column:
    """The deterministic sampler: a hash of seed, kind, rule, document and field, without the policy's id."""
    rate = policy.rates.get(kind, 0.0)
    if rate <= 0:
        return F.lit(False)
    identity = F.lit(identity) if isinstance(identity, str) else identity
    if policy.sampler == 2:
        key = F.concat_ws("|", F.lit(policy.seed), F.lit(kind), identity, doc.cast("string"), name, F.lit("qa-hash-v2"))
    else:
        key = F.concat_ws("|", F.lit(policy.seed), F.lit(policy.policy_id), doc.cast("string"), name, F.lit("qa-hash-v1"))
    return V.unit_hash(key) < V.rate_bound(rate)


def first_rule(rules: list[tuple[str, Column]]) -> Column:
    """The id of the first rule whose condition holds; null if none does."""
    out = None
    for rule, condition in rules:
        out = F.when(condition, rule) if out is None else out.when(condition, rule)
    return out if out is not None else F.lit(None).cast("string")


def rules_of(policy: Policy) -> dict[str, Column]:
    """The first class rule, page-evidence rule and cohort of a slot that the policy has."""
    name = F.col("field")
    cohort = [(i, reduce(lambda a, b: a & b, [F.col(c) == x for c, x in (("field", f), ("tier", t), ("strength", s)) if x], F.lit(True))) for i, f, t, s in policy.cohorts]
    return {
        "expected": first_rule([(r[0], (name == r[1]) & (F.col("doc_class") == r[2] if len(r) > 2 else F.lit(True))) for r in policy.absent]),
        "evidenced": first_rule([(r[0], (name == r[1]) & (F.col("absence_evidence") == "absent_corroborated")) for r in policy.evidenced]),
        "cohort": first_rule(cohort),
    }


def apply_absences(slots: DataFrame, policy: Policy) -> DataFrame:
    """The slots with a missing value that a rule expects as ``expected_absent`` in place of ``fail``, and that rule."""
    rules = rules_of(policy)
    rule = F.coalesce(rules["expected"], rules["evidenced"])
    missing = (F.col("extraction_present") == "fail") & rule.isNotNull()
    return slots.withColumns({"applied_rule": F.when(missing, rule), "extraction_present": F.when(missing, "expected_absent").otherwise(F.col("extraction_present"))})


def _decision(policy: Policy, i: int, explain: bool) -> Column:
    """(policy_id, route, reasons, rule_id) from the columns that ``route_all`` puts before it; reasons where they are asked for."""
    name, doc = F.col("field"), F.col("doc_id")
    own = lambda c: F.col(f"__{c}_{i}")
    rule, cohort, absent, hard, failed = own("rule"), own("cohort"), own("absent"), own("hard"), own("failed")
    hit_absent = F.when(own("expected").isNotNull(), qa_hit(policy, "absent_expected", rule, doc, name)).otherwise(qa_hit(policy, "absent_evidenced", rule, doc, name))
    hit_cohort = qa_hit(policy, "cohort_relax", cohort, doc, name)
    hit_tier1 = (F.col("tier") == "TIER1") & qa_hit(policy, "policy_accepted_tier1", "policy_accepted_tier1", doc, name) if not policy.tier1_explicit else F.lit(False)
    prefix = F.when(own("expected").isNotNull(), "EXPECTED_ABSENT").otherwise("ABSENT_EVIDENCED")
    tag = lambda head, column: F.concat(F.lit(head), column)
    made = lambda to, reasons: F.struct(F.lit(to).alias("route"), *([reasons().alias("reasons")] if explain else []))
    out = lambda to, *codes: made(to, lambda: F.array(*codes))
    listed = lambda head, codes: made("review", lambda: F.transform(own(codes) if codes == "fails" else F.col(codes), lambda x: F.concat(F.lit(head), x)))
    found = (
        F.when(F.col("doc_blocked"), out("block", F.lit("INFRA_BLOCKED")))
        .when(absent & hit_absent, out("review", F.concat(prefix, F.lit(":"), rule), tag("QA_SAMPLE:", rule)))
        .when(absent, out("auto_absent", F.concat(prefix, F.lit(":"), rule)))
        .when(~hard & cohort.isNotNull() & hit_cohort, out("review", tag("POLICY_ACCEPT:", cohort), tag("QA_SAMPLE:", cohort)))
        .when(~hard & cohort.isNotNull(), out("auto_accept", tag("POLICY_ACCEPT:", cohort)))
        .when(~hard & F.col("__warned"), listed("GATE_WARNING:", "__warns"))
        .when(~hard & hit_tier1, out("review", F.lit("CLEAN"), F.lit("QA_SAMPLE:policy_accepted_tier1")))
        .when(~hard, out("auto_accept", F.lit("CLEAN")))
        .when(F.col("slot_blocking"), out("review", F.lit("SLOT_BLOCKING")))
        .when(F.col("strength") == "unsupported", out("review", F.lit("UNSUPPORTED")))
        .when(failed, listed("GATE_FAIL:", "fails"))
        .otherwise(out("review", F.lit("LABEL_CONVENTION_DISPUTED")))
    )
    return F.struct(F.lit(policy.policy_id).alias("policy_id"), found.alias("d"), rule.alias("rule_id"))


def route_all(slots: DataFrame, policies: list[Policy], explain: bool = True) -> DataFrame:
    """The slots, each once under each policy, with route, rule and, if asked to ``explain``, reasons; they also need
    doc_class and absence_evidence.

    The slot plan runs once whatever the number of policies: a policy is a projection, and all of them are one list.
    """
    keep, n = slots.columns, range(len(policies))
    gate = lambda verdict: F.array_compact(F.array(*[F.when(F.col(g) == verdict, g) for g in sorted(gates.GATES)]))
    some = lambda verdict, names: reduce(lambda a, b: a | b, [F.col(g) == verdict for g in names])
    ruled = [c.alias(f"__{name}_{i}") for i, p in enumerate(policies) for name, c in rules_of(p).items()]
    lists = [gate("fail").alias("__all"), gate("warning").alias("__warns")] if explain else []
    others = some("fail", [g for g in gates.GATES if g != "extraction_present"])
    rows = slots.select(*keep, *lists, others.alias("__others"), (F.col("extraction_present") == "fail").alias("__empty"), some("warning", gates.GATES).alias("__warned"), *ruled)
    rows = rows.select("*", *[F.coalesce(f"__expected_{i}", f"__evidenced_{i}").alias(f"__rule_{i}") for i in n])
    # a missing value that a rule expects is no failure
    missing = lambda i: F.col(f"__rule_{i}").isNotNull() & F.col("__empty")
    if explain:
        less = F.array_except("__all", F.array(F.lit("extraction_present")))
        rows = rows.select("*", *[F.when(missing(i), less).otherwise(F.col("__all")).alias(f"__fails_{i}") for i in n])
    weak = (F.col("strength") == "unsupported") | F.col("disputed") | F.col("slot_blocking")
    rows = rows.select("*", *[(F.col("__others") | F.col("__empty") & F.col(f"__rule_{i}").isNull()).alias(f"__failed_{i}") for i in n])
    judged = []
    for i in n:
        failed = F.col(f"__failed_{i}")
        judged += [(missing(i) & ~failed & ~F.col("slot_blocking")).alias(f"__absent_{i}"), (failed | weak).alias(f"__hard_{i}")]
    # a list even of one policy: a filter on the route would else be worked out from all expressions before it
    rows = rows.select("*", *judged).select(*keep, F.inline(F.array(*[_decision(p, i, explain) for i, p in enumerate(policies)])))
    return rows.select(*keep, "policy_id", "d.route", *(["d.reasons"] if explain else []), "rule_id")


def route(slots: DataFrame, policy: Policy, explain: bool = True) -> DataFrame:
    """The slots under one policy."""
    return route_all(slots, [policy], explain)


def ranked(frame: DataFrame, *order: Column) -> DataFrame:
    """``position`` from 0 in a total order, without one task that sees all rows.

    The frame is written once, dealt by range of the order and written with its parts; the counts of the parts (one row
    each) give each part's first position.
    """
    parts = tables.cut(tables.cut(frame).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("__part").orderBy(*order)
    return (
        parts.join(F.broadcast(first), "__part")
        .withColumn("position", (F.col("__first") + F.row_number().over(inside) - 1).cast("long"))
        .drop("__part", "__first")
    )


def triage(routed: DataFrame) -> DataFrame:
    """Queue position: weakest support first, then what is in the queue, then document and field."""
    rank = F.create_map(*[F.lit(x) for kv in gates.STRENGTH_RANK.items() for x in kv])[F.col("strength")]
    frame = routed.withColumns({"__rank": rank, "__out": (~F.col("route").isin("review", "block")).cast("int")})
    return ranked(frame, F.col("__rank"), F.col("__out"), F.col("doc_id"), F.col("field")).drop("__rank", "__out")
