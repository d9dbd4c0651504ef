"""Queries over the slot table: normalisers, gates, duplicates, routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from slotforge.functions import values as V
from slotforge.operators import gates, routing
from slotforge.queries import base, query
from slotforge.queries.base import with_sql

POLICIES = [
    routing.Policy("P1"),
    routing.Policy("P2", absent=(("R1", "due_date", "invoice"), ("R2", "seller_vat_id")), cohorts=(("C1", "seller_name", None, "corroborated"),), rates={"absent_expected": 0.2, "cohort_relax": 0.2}),
    routing.Policy(
        "P3", absent=(("R1", "due_date", "invoice"),), evidenced=(("E1", "total_vat"), ("E2", "due_date")), cohorts=(("C2", None, "TIER2", None),),
        rates={"absent_expected": 0.2, "absent_evidenced": 0.1, "cohort_relax": 0.05, "policy_accepted_tier1": 0.05}, tier1_explicit=False,
    ),
]


def routable(spark, d):
    """The slots with a class and an absence probe, both by rule from the document's id."""
    return base.slots(spark, d).withColumns({
        "doc_class": F.when(F.col("doc_id") % 2 == 0, "invoice").otherwise("contract"),
        "absence_evidence": F.when((F.col("doc_id") + F.col("ord")) % 3 == 0, "absent_corroborated").otherwise("label_present"),
    })


def routed(spark, d):
    return routing.route_all(routable(spark, d), POLICIES)


_HIT = "substr(sha256('qa|' || {kind} || '|' || {rule} || '|' || doc_id || '|' || field || '|qa-hash-v2'), 1, 16) < '{bound}'"


def _hit(kind: str, rule: str, rate: float) -> str:
    return _HIT.format(kind=f"'{kind}'", rule=rule, bound=V.rate_bound(rate))


_FAILS = "list_sort(list_filter([{}], lambda x: x IS NOT NULL))"
_FAIL_SQL = _FAILS.format(", ".join(f"CASE WHEN {g} = 'fail' THEN '{g}' END" for g in gates.GATES))
_WARN_SQL = _FAILS.format(", ".join(f"CASE WHEN {g} = 'warning' THEN '{g}' END" for g in gates.GATES))
ROUTES_SQL = f"""base_ AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'invoice' ELSE 'contract' END doc_class, (doc_id + ord) % 3 = 0 corroborated,
 {_FAIL_SQL} fails0, {_WARN_SQL} warns FROM slots),
ruled AS (SELECT base_.*, policy_id,
 CASE WHEN policy_id = 'P2' AND field = 'due_date' AND doc_class = 'invoice' THEN 'R1' WHEN policy_id = 'P2' AND field = 'seller_vat_id' THEN 'R2'
  WHEN policy_id = 'P3' AND field = 'due_date' AND doc_class = 'invoice' THEN 'R1' END expected,
 CASE WHEN policy_id = 'P3' AND corroborated AND field = 'total_vat' THEN 'E1' WHEN policy_id = 'P3' AND corroborated AND field = 'due_date' THEN 'E2' END evidenced,
 CASE WHEN policy_id = 'P2' AND field = 'seller_name' AND strength = 'corroborated' THEN 'C1' WHEN policy_id = 'P3' AND tier = 'TIER2' THEN 'C2' END cohort
 FROM base_, (VALUES ('P1'), ('P2'), ('P3')) p(policy_id)),
ready AS (SELECT *, coalesce(expected, evidenced) rule_id, coalesce(expected, evidenced) IS NOT NULL AND extraction_present = 'fail' miss,
 CASE WHEN coalesce(expected, evidenced) IS NOT NULL AND extraction_present = 'fail' THEN list_filter(fails0, lambda x: x <> 'extraction_present') ELSE fails0 END fails,
 CASE WHEN expected IS NOT NULL THEN 'EXPECTED_ABSENT:' ELSE 'ABSENT_EVIDENCED:' END prefix FROM ruled),
flags AS (SELECT *, miss AND len(fails) = 0 AND NOT slot_blocking absent, len(fails) > 0 OR strength = 'unsupported' OR disputed OR slot_blocking hard,
 CASE WHEN expected IS NOT NULL THEN {_hit("absent_expected", "rule_id", 0.2)} ELSE {_hit("absent_evidenced", "rule_id", 0.1)} END hit_absent,
 CASE WHEN policy_id = 'P2' THEN {_hit("cohort_relax", "cohort", 0.2)} ELSE {_hit("cohort_relax", "cohort", 0.05)} END hit_cohort,
 policy_id = 'P3' AND tier = 'TIER1' AND {_hit("policy_accepted_tier1", "'policy_accepted_tier1'", 0.05)} hit_tier1 FROM ready),
routed AS (SELECT *, CASE WHEN doc_blocked THEN 'block' WHEN absent AND hit_absent THEN 'review' WHEN absent THEN 'auto_absent'
 WHEN NOT hard AND cohort IS NOT NULL THEN CASE WHEN hit_cohort THEN 'review' ELSE 'auto_accept' END WHEN NOT hard AND len(warns) > 0 THEN 'review'
 WHEN NOT hard AND hit_tier1 THEN 'review' WHEN NOT hard THEN 'auto_accept' ELSE 'review' END route,
 CASE WHEN doc_blocked THEN ['INFRA_BLOCKED'] WHEN absent AND hit_absent THEN [prefix || rule_id, 'QA_SAMPLE:' || rule_id] WHEN absent THEN [prefix || rule_id]
 WHEN NOT hard AND cohort IS NOT NULL AND hit_cohort THEN ['POLICY_ACCEPT:' || cohort, 'QA_SAMPLE:' || cohort] WHEN NOT hard AND cohort IS NOT NULL THEN ['POLICY_ACCEPT:' || cohort]
 WHEN NOT hard AND len(warns) > 0 THEN list_transform(warns, lambda x: 'GATE_WARNING:' || x) WHEN NOT hard AND hit_tier1 THEN ['CLEAN', 'QA_SAMPLE:policy_accepted_tier1']
 WHEN NOT hard THEN ['CLEAN'] WHEN slot_blocking THEN ['SLOT_BLOCKING'] WHEN strength = 'unsupported' THEN ['UNSUPPORTED']
 WHEN len(fails) > 0 THEN list_transform(fails, lambda x: 'GATE_FAIL:' || x) ELSE ['LABEL_CONVENTION_DISPUTED'] END reasons FROM flags)"""


def routed_sql(body: str, more: str = "") -> str:
    return with_sql("facts", body, ROUTES_SQL + (",\n" + more if more else ""))


_AMOUNT_SQL = """WITH c AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) c FROM lineitem)
SELECT l_orderkey AS doc_id, l_linenumber AS ord, (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS amount FROM c"""


@query("f1_amount", _AMOUNT_SQL)
def f1_amount(spark, d):
    """Each price, written in one of five styles, read back as the same amount."""
    rows = base.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", base.cents(F.col("l_extendedprice")).alias("c"))
    whole, part = F.floor(F.col("c") / 100), F.lpad((F.col("c") % 100).cast("string"), 2, "0")
    grouped = F.regexp_replace(F.format_number(whole, 0), ",", ",")
    n = F.col("l_orderkey") % 5
    text = (
        F.when(n == 0, F.concat(F.lit("$ "), grouped, F.lit("."), part))
        .when(n == 1, F.concat(F.translate(grouped, ",", "."), F.lit(","), part, F.lit(" EUR")))
        .when(n == 2, F.concat(F.lit("CHF "), F.translate(grouped, ",", "'"), F.lit("."), part))
        .when(n == 3, F.concat(F.lit("No 7: "), whole.cast("string"), F.lit(","), part))
        .otherwise(F.concat(whole.cast("string"), F.lit("."), part))
    )
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), V.amount(text).cast("string").alias("amount"))


@query("f2_f3_f4_normalised", with_sql("n1", "SELECT doc_id, field, v AS normalised FROM n1"))
def f2_f3_f4(spark, d):
    return base.long(base.wide(spark, d)).select("doc_id", "field", V.normalised(F.col("field"), F.col("value")).alias("normalised"))


@query("f5_f6_date_order", """SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%-m-%-d') WHEN 1 THEN strftime(o_orderdate, '%Y-%-m-%-d')
 ELSE CASE WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%Y-%-m-%-d') ELSE strftime(o_orderdate, '%Y-%-d-%-m') END END AS ymd FROM orders""")
def f5_f6(spark, d):
    """Dates written year first, day first or month first; a doubtful month-first one is read day first."""
    when, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format(when, "yyyy-MM-dd")).when(k == 1, F.date_format(when, "dd.MM.yyyy")).otherwise(F.date_format(when, "MM/dd/yyyy"))
    parts = V.date_parts(text)
    return base.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.array_join(V.date_ymd(parts, V.date_order(parts)).cast("array<string>"), "-").alias("ymd"))


@query("f9_wellformed", with_sql("m1", "SELECT doc_id, field, CASE WHEN value = '--' THEN 'C6_code' WHEN value = '99/99' THEN 'C5_date' END AS problem FROM m1 WHERE value IS NOT NULL"))
def f9(spark, d):
    return base.long(base.wide(spark, d)).where("value IS NOT NULL").select("doc_id", "field", V.malformed(F.col("field"), F.col("value")).alias("problem"))


_CLASS_SQL = "CASE WHEN coalesce(trim({0}), '') = '' THEN 'no_claim' " + " ".join(f"WHEN regexp_matches(lower({{0}}), '{p}') THEN '{n}'" for n, p in V.CLASSES) + " ELSE 'unmapped' END"


@query("f10_document_class", f"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'Credit Note against Invoice' WHEN 2 THEN 'Pro-forma' WHEN 3 THEN 'Order Confirmation'
 WHEN 4 THEN 'Purchase ORDER' WHEN 5 THEN 'quote' WHEN 6 THEN 'Agreement' WHEN 7 THEN 'check' WHEN 8 THEN 'Sales voucher' WHEN 9 THEN 'reorder list' ELSE ' ' END txt FROM orders)
SELECT {_CLASS_SQL.format("txt")} AS doc_class, count(*) AS n FROM t GROUP BY 1""")
def f10(spark, d):
    texts = [None, "Credit Note against Invoice", "Pro-forma", "Order Confirmation", "Purchase ORDER", "quote", "Agreement", "check", "Sales voucher", "reorder list", " "]
    text = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("o_orderkey") % 11).cast("int"))
    return base.table(spark, d, "orders").groupBy(V.document_class(text).alias("doc_class")).agg(F.count("*").alias("n"))


@query("f17_label_convention", with_sql("ident", "SELECT doc_id, disputed FROM ident"))
def f17(spark, d):
    return gates.identities(base.wide(spark, d)).select("doc_id", "disputed")


@query("f18_risk_reasons", with_sql("ident", """SELECT doc_id, array_to_string(list_filter([CASE WHEN invoice_number IS NULL THEN 'missing:invoice_number' END, CASE WHEN total_gross IS NULL THEN 'missing:total_gross' END,
 CASE WHEN total_net IS NULL THEN 'missing:total_net' END, CASE WHEN total_vat IS NULL THEN 'missing:total_vat' END, CASE WHEN amount_due IS NULL THEN 'missing:amount_due' END,
 CASE WHEN seller_vat_id IS NULL THEN 'missing:seller_vat_id' END, CASE WHEN NOT c1 THEN 'identity:c1' END, CASE WHEN NOT c2 THEN 'identity:c2' END, CASE WHEN NOT c3 THEN 'identity:c3' END], lambda x: x IS NOT NULL), ',') AS reasons
 FROM wide JOIN ident USING (doc_id)"""))
def f18(spark, d):
    w = base.wide(spark, d)
    reasons = [F.when(F.col(n).isNull(), f"missing:{n}") for n in V.TIER1] + [F.when(~F.col(c), f"identity:{c}") for c in ("c1", "c2", "c3")]
    return w.join(gates.identities(w), "doc_id").select("doc_id", F.array_join(F.array_compact(F.array(*reasons)), ",").alias("reasons"))


@query("f19_target_ids", with_sql("m1", "SELECT doc_id, field, 'T-' || substr(sha256('SNAP|' || doc_id || '|' || field), 1, 12) AS target_id FROM m1"))
def f19(spark, d):
    return base.long(base.wide(spark, d)).select("doc_id", "field", V.target_id(F.lit("SNAP"), F.col("doc_id").cast("string"), F.col("field")).alias("target_id"))


@query("f21_json_paths", "SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1")
def f21(spark, d):
    return base.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("k_sum"))


_DUP = "SELECT o_custkey seller, o_orderpriority number, o_orderkey doc_id, CAST(round(o_totalprice) AS BIGINT) // 40000 gross, year(o_orderdate) date FROM orders"


def _claims(spark, d):
    return base.table(spark, d, "orders").select(
        F.col("o_custkey").alias("seller"), F.col("o_orderpriority").alias("number"), F.col("o_orderkey").alias("doc_id"),
        F.floor(F.round("o_totalprice", 0) / 40000).alias("gross"), F.year("o_orderdate").alias("date"),
    )


@query("a1_duplicate_groups", f"""SELECT seller, number, count(DISTINCT doc_id) AS documents, CASE WHEN count(DISTINCT gross || '/' || date) > 1 THEN 'content_conflict' ELSE 'resubmission' END AS kind,
 min(doc_id) AS first_doc FROM ({_DUP}) GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 1""")
def a1(spark, d):
    return gates.duplicates(_claims(spark, d)).select("seller", "number", "documents", "kind", "first_doc")


@query("g8_duplicate_stamps", f"""WITH c AS ({_DUP}), g AS (SELECT seller, number, count(DISTINCT doc_id) n, count(DISTINCT gross || '/' || date) s FROM c GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 1)
, m AS (SELECT seller, number, list(doc_id ORDER BY doc_id) l FROM c JOIN g USING (seller, number) GROUP BY 1, 2)
SELECT doc_id, CASE WHEN s > 1 THEN 'content_conflict' ELSE 'resubmission' END AS kind, n - 1 AS others, array_to_string(list_filter(l, lambda x: x <> doc_id)[:20], ',') AS other_docs FROM c JOIN g USING (seller, number) JOIN m USING (seller, number)""")
def g8(spark, d):
    return gates.stamp_duplicates(_claims(spark, d)).select("doc_id", "kind", "others", F.array_join(F.col("other_docs").cast("array<string>"), ",").alias("other_docs"))


@query("g1_arithmetic", with_sql("arith", "SELECT m1.doc_id, m1.field, coalesce(verdict, 'unavailable') AS verdict FROM m1 LEFT JOIN arith ON arith.doc_id = m1.doc_id AND arith.field = m1.field"))
def g1(spark, d):
    return base.slots(spark, d).select("doc_id", "field", F.col("arithmetic_consistency").alias("verdict"))


for _id, _gate in (("g2_field_wellformed", "field_wellformed"), ("g3_extraction_present", "extraction_present"), ("g4_citation_holds", "citation_holds"), ("g5_cross_mode_agreement", "cross_mode_agreement"), ("g6_visual_corroboration", "visual_corroboration")):
    query(_id, with_sql("facts", f"SELECT doc_id, field, {_gate} AS verdict FROM slots"))(lambda spark, d, g=_gate: base.slots(spark, d).select("doc_id", "field", F.col(g).alias("verdict")))


@query("g7_g11_findings", with_sql("facts", """, """.join([]) + """SELECT gate_id, severity, blocking, count(*) AS n FROM (""" + " UNION ALL ".join(
    f"SELECT '{g}' gate_id, CASE WHEN {g} = 'warning' THEN 'P2' ELSE 'P1' END severity, {'field = ' + chr(39) + 'invoice_number' + chr(39) if g == 'extraction_present' else 'false'} blocking FROM slots WHERE {g} IN ('fail', 'warning')" for g in gates.GATES
) + """ UNION ALL SELECT 'ocr_available', 'P0', true FROM (SELECT DISTINCT doc_id FROM slots WHERE doc_blocked) UNION ALL SELECT 'second_mode_present', 'P0', true FROM (SELECT DISTINCT doc_id FROM slots WHERE second_missing)) GROUP BY 1, 2, 3"""))
def g11(spark, d):
    return gates.findings(base.slots(spark, d)).groupBy("gate_id", "severity", "blocking").agg(F.count("*").alias("n"))


@query("j7_mode_agreement", with_sql("n2", "SELECT n1.field, count(*) AS slots, count_if(n1.v IS NOT DISTINCT FROM n2.v) AS agree, count_if(n1.v IS NULL AND n2.v IS NULL) AS both_missing FROM n1 JOIN n2 USING (doc_id, field) GROUP BY 1"))
def j7(spark, d):
    m1 = base.long(base.wide(spark, d))
    both = gates.agreement(m1, base.mode2(m1))
    return both.groupBy("field").agg(F.count("*").alias("slots"), F.count_if("agree").alias("agree"), F.count_if(F.col("first").isNull() & F.col("second").isNull()).alias("both_missing"))


@query("j8_reader_corroboration", with_sql("facts", "SELECT doc_id, field, attempted, live, eq AS equal FROM vis"))
def j8(spark, d):
    m1 = base.long(base.wide(spark, d))
    return gates.corroboration(m1, base.readings(m1)).select("doc_id", "field", "attempted", "live", "equal")


@query("a2_support_strength", with_sql("facts", "SELECT field, strength, n_tiers, count(*) AS n FROM slots GROUP BY 1, 2, 3"))
def a2(spark, d):
    return base.slots(spark, d).groupBy("field", "strength", "n_tiers").agg(F.count("*").alias("n"))


@query("r3_j9_slot_records", with_sql("facts", "SELECT doc_id, field, value, strength, applicability, slot_blocking, doc_blocked FROM slots"))
def r3(spark, d):
    return base.slots(spark, d).select("doc_id", "field", "value", "strength", "applicability", "slot_blocking", "doc_blocked")


@query("r1_routes", routed_sql("SELECT policy_id, doc_id, field, route, array_to_string(reasons, ',') AS reasons, rule_id FROM routed"))
def r1(spark, d):
    return routed(spark, d).select("policy_id", "doc_id", "field", "route", F.array_join("reasons", ",").alias("reasons"), "rule_id")


@query("v10_qa_probes", routed_sql("SELECT policy_id, field, count(*) AS probes FROM routed WHERE reasons[-1] LIKE 'QA_SAMPLE:%' GROUP BY 1, 2"))
def v10(spark, d):
    return routed(spark, d).where(F.element_at("reasons", -1).startswith("QA_SAMPLE:")).groupBy("policy_id", "field").agg(F.count("*").alias("probes"))


_LEGACY = routing.Policy("H7", seed="s", rates={"policy_accepted_tier1": 0.1}, tier1_explicit=False, sampler=1)


@query("v10_legacy_probes", with_sql("facts", f"""SELECT field, count(*) AS probes FROM slots WHERE tier = 'TIER1' AND substr(sha256('s|H7|' || doc_id || '|' || field || '|qa-hash-v1'), 1, 16) < '{V.rate_bound(0.1)}' GROUP BY 1"""))
def v10_legacy(spark, d):
    """Which slots the older sampler draws, as a replay of an old run needs it."""
    hit = routing.qa_hit(_LEGACY, "policy_accepted_tier1", "policy_accepted_tier1", F.col("doc_id"), F.col("field"))
    return base.slots(spark, d).where((F.col("tier") == "TIER1") & hit).groupBy("field").agg(F.count("*").alias("probes"))


@query("j10_r2_rules", routed_sql("""SELECT policy_id, field, coalesce(rule_id, 'none') AS rule, coalesce(cohort, 'none') AS cohort, count_if(extraction_present = 'fail' AND rule_id IS NOT NULL) AS expected_absent, count(*) AS slots FROM ready GROUP BY 1, 2, 3, 4"""))
def j10(spark, d):
    """The rule and the cohort that match each slot under each policy, and the missing values that they make expected."""
    rows = routable(spark, d)
    parts = []
    for p in POLICIES:
        r = routing.rules_of(p)
        own = routing.apply_absences(rows.withColumns({"rule": F.coalesce(r["expected"], r["evidenced"]), "cohort": r["cohort"]}), p)
        parts.append(own.groupBy(F.lit(p.policy_id).alias("policy_id"), "field", F.coalesce("rule", F.lit("none")).alias("rule"), F.coalesce("cohort", F.lit("none")).alias("cohort")).agg(
            F.count_if(F.col("extraction_present") == "expected_absent").alias("expected_absent"), F.count("*").alias("slots")
        ))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("a3_matrix_summary", routed_sql("SELECT policy_id, strength, route, count(*) AS slots, count_if(disputed) AS disputed, count_if(slot_blocking) AS blocking, count_if(route IN ('review', 'block')) AS queue FROM routed GROUP BY 1, 2, 3"))
def a3(spark, d):
    return routed(spark, d).groupBy("policy_id", "strength", "route").agg(
        F.count("*").alias("slots"), F.count_if("disputed").alias("disputed"), F.count_if("slot_blocking").alias("blocking"), F.count_if(F.col("route").isin("review", "block")).alias("queue")
    )


@query("v4_r4_triage_order", routed_sql("""SELECT doc_id, field, row_number() OVER (ORDER BY CASE strength WHEN 'unsupported' THEN 0 WHEN 'single_source' THEN 1 ELSE 2 END,
 CAST(route NOT IN ('review', 'block') AS INT), doc_id, field) - 1 AS position FROM routed WHERE policy_id = 'P2'"""))
def v4(spark, d):
    order = routing.route(routable(spark, d), POLICIES[1]).select("doc_id", "field", "strength", "route")
    return routing.triage(order).select("doc_id", "field", "position")


@query("a18_policy_replay", routed_sql("""SELECT policy_id, coalesce(doc_class, 'all') AS stratum, count_if(route = 'review') AS review, count_if(route = 'auto_accept') AS auto_accept,
 count_if(route = 'auto_absent') AS auto_absent, count_if(route = 'block') AS block FROM routed GROUP BY GROUPING SETS ((policy_id, doc_class), (policy_id))"""))
def a18(spark, d):
    rows = routed(spark, d)
    count = lambda r: F.count_if(F.col("route") == r).alias(r)
    return rows.groupingSets([["policy_id", "doc_class"], ["policy_id"]], "policy_id", "doc_class").agg(*[count(r) for r in ("review", "auto_accept", "auto_absent", "block")]).select(
        "policy_id", F.coalesce("doc_class", F.lit("all")).alias("stratum"), "review", "auto_accept", "auto_absent", "block"
    )


@query("a32_route_by_field", routed_sql("SELECT route, coalesce(field, '*') AS field, count(*) AS n FROM routed GROUP BY GROUPING SETS ((route), (field, route))"))
def a32(spark, d):
    return routed(spark, d).groupingSets([["route"], ["field", "route"]], "route", "field").agg(F.count("*").alias("n")).select("route", F.coalesce("field", F.lit("*")).alias("field"), "n")


@query("a42_open_shapes", routed_sql("""SELECT policy_id, shape, count(*) AS docs FROM (SELECT policy_id, doc_id, coalesce(string_agg(field, '+' ORDER BY field) FILTER (WHERE route = 'review' AND tier = 'TIER1'), '') shape FROM routed GROUP BY 1, 2) GROUP BY 1, 2"""))
def a42(spark, d):
    rows = routing.route_all(routable(spark, d), POLICIES, explain=False)
    shapes = rows.groupBy("policy_id", "doc_id").agg(V.field_bits((F.col("route") == "review") & (F.col("tier") == "TIER1")).alias("open"))
    counted = shapes.groupBy("policy_id", "open").agg(F.count("*").alias("docs"))
    return counted.select("policy_id", F.array_join(V.fields_of("open"), "+").alias("shape"), "docs")


@query("a7_document_touch", routed_sql("""SELECT policy_id, count(*) AS docs, count_if(touched) AS touched, count_if(NOT touched) AS zero_touch, CAST(sum(open_slots) AS BIGINT) AS open_slots FROM
 (SELECT policy_id, doc_id, bool_or(route IN ('review', 'block')) touched, count_if(route IN ('review', 'block')) open_slots FROM routed GROUP BY 1, 2) GROUP BY 1"""))
def a7(spark, d):
    open_ = F.col("route").isin("review", "block")
    docs = routed(spark, d).groupBy("policy_id", "doc_id").agg(F.bool_or(open_).alias("touched"), F.count_if(open_).alias("open_slots"))
    return docs.groupBy("policy_id").agg(F.count("*").alias("docs"), F.count_if("touched").alias("touched"), F.count_if(~F.col("touched")).alias("zero_touch"), F.sum("open_slots").alias("open_slots"))


@query("a38_reader_consensus", with_sql("nr", """SELECT state, count(*) AS slots FROM (SELECT doc_id, field, CASE WHEN count(v) = 0 THEN 'blind' WHEN count(DISTINCT v) > 1 THEN 'split' ELSE 'agree' END state FROM nr GROUP BY 1, 2) GROUP BY 1"""))
def a38(spark, d):
    rows = base.readings(base.long(base.wide(spark, d))).withColumn("v", V.normalised(F.col("field"), V.blank_to_null(F.col("value"))))
    states = rows.groupBy("doc_id", "field").agg(F.when(F.count("v") == 0, "blind").when(F.count_distinct("v") > 1, "split").otherwise("agree").alias("state"))
    return states.groupBy("state").agg(F.count("*").alias("slots"))
