"""Queries over samples, digests, sets, sources and derivations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from slotforge.functions import dates
from slotforge.functions import values as V
from slotforge.operators import blocks, routing, sampling, tables, text
from slotforge.queries import base, query
from slotforge.queries.base import table
from slotforge.queries.slots import POLICIES, routable, routed, routed_sql
from slotforge.sources import readers


@query("v11_equidistant_sample", "SELECT i AS idx, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 p, count(*) OVER () n FROM documents), range(50) r(i) WHERE p = i * n // 50")
def v11(spark, d):
    return sampling.equidistant(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


@query("v12_v13_hash_split", """SELECT doc_id, lang, CASE WHEN r <= 20 THEN 'evaluation' ELSE 'development' END AS part FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('salt|' || doc_id), doc_id) r FROM documents)""")
def v12(spark, d):
    return sampling.hash_split(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "salt", 20, "lang").select("doc_id", "lang", "part")


@query("v15_dense_ids", "SELECT doc_id, 'FC-' || lpad(CAST(row_number() OVER (ORDER BY source, doc_id) AS VARCHAR), 6, '0') AS id FROM documents")
def v15(spark, d):
    return sampling.dense_ids(table(spark, d, "documents").select("doc_id", "source"), "FC", F.col("source"), F.col("doc_id")).select("doc_id", "id")


def _id_sum(i: int) -> str:
    return f"coalesce(sum(CAST(('0x' || substr(h, {1 + 12 * i}, 12)) AS BIGINT)), 0)"


def _set_digest_sql(group: str) -> str:
    return f"SELECT {group}, count(doc_id) AS n, sha256(count(doc_id) || '|' || {_id_sum(0)} || '|' || {_id_sum(1)}) AS digest FROM (SELECT {group}, doc_id, sha256(CAST(doc_id AS VARCHAR)) h FROM (SELECT DISTINCT {group}, doc_id FROM documents)) GROUP BY 1"


@query("a35_set_digest", _set_digest_sql("source"))
def a35(spark, d):
    """The ids of each source, all of them."""
    return sampling.set_digests(table(spark, d, "documents"), "doc_id", "source")


@query("a35_set_digests_all", _set_digest_sql("lang"))
def a35_all(spark, d):
    """The ids of each language, all of them."""
    return sampling.set_digests(table(spark, d, "documents"), "doc_id", "lang")


def _digest_sql(name: str, t: str, columns: tuple[str, ...]) -> str:
    h = "sha256(" + " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in columns) + ")"
    word = lambda i: f"sum(CAST(('0x' || substr(h, {1 + 12 * i}, 12)) AS BIGINT))"
    return f"SELECT '{name}' AS name, count(*) AS rows, sha256(count(*) || '|' || {word(0)} || '|' || {word(1)}) AS digest FROM (SELECT {h} h FROM {t})"


_TABLES = {"benchmark": ("item_id", "text"), "conversations": ("conv_id", "turn", "role", "text"), "labels": ("doc_id", "quality", "toxic")}


@query("a36_snapshot_digests", " UNION ALL ".join(_digest_sql(t, t, c) for t, c in _TABLES.items()))
def a36(spark, d):
    return sampling.snapshot({t: (table(spark, d, t), c) for t, c in _TABLES.items()})


@query("f22_run_identity", "SELECT 'P2' AS candidate, max(CASE WHEN name = 'labels' THEN digest END) AS labels, max(CASE WHEN name = 'benchmark' THEN digest END) AS benchmark, CAST(NULL AS VARCHAR) AS adjudications, 'benchmark' AS changed FROM ("
    + " UNION ALL ".join(_digest_sql(t, t, _TABLES[t]) for t in ("labels", "benchmark")) + ")")
def f22(spark, d):
    """An evaluation bound to the digests of its inputs, and what is not the same any more after one input lost a row."""
    inputs = {"labels": (table(spark, d, "labels"), _TABLES["labels"]), "benchmark": (table(spark, d, "benchmark"), _TABLES["benchmark"]), "adjudications": (None, ())}
    bound = sampling.bind_identity(spark.createDataFrame([("P2",)], "candidate string"), sampling.run_identity(inputs))
    later = inputs | {"benchmark": (table(spark, d, "benchmark").where("item_id <> 0"), _TABLES["benchmark"])}
    return bound.join(sampling.identity_changes(bound, sampling.run_identity(later)), "candidate")


@query("a34_exposure", "SELECT reasons, n, count(*) AS docs FROM (SELECT doc_id, string_agg(r, '+' ORDER BY r) reasons, count(*) n FROM (SELECT doc_id, 'labelled' r FROM labels UNION SELECT doc_id, 'english' FROM documents WHERE lang = 'en' UNION SELECT doc_id, 'long' FROM documents WHERE n_chars > 3000) GROUP BY 1) GROUP BY 1, 2")
def a34(spark, d):
    docs = table(spark, d, "documents")
    lists = {"labelled": table(spark, d, "labels"), "english": docs.where("lang = 'en'"), "long": docs.where("n_chars > 3000")}
    return sampling.exposure(lists, "doc_id").groupBy("reasons", "n").agg(F.count("*").alias("docs"))


@query("o4_set_difference", "SELECT side, count(*) AS n FROM (SELECT CASE WHEN l AND r THEN 'both' WHEN l THEN 'first' ELSE 'second' END side FROM (SELECT DISTINCT doc_id, true l FROM labels) FULL JOIN (SELECT DISTINCT doc_id, true r FROM documents WHERE n_chars > 2000) USING (doc_id)) GROUP BY 1")
def o4(spark, d):
    return sampling.unlike(table(spark, d, "labels"), table(spark, d, "documents").where("n_chars > 2000"), "doc_id")


@query("j11_pool", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT doc_id FROM documents WHERE lang IN ('en', 'de'))")
def j11(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti").join(docs.where("lang IN ('en', 'de')").select("doc_id"), "doc_id", "left_semi")


@query("a40_rich_pool", "SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 4")
def a40(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds")).where("kinds >= 4")


@query("j17_replay_identity", "SELECT artifact, count(DISTINCT digest) AS digests FROM (SELECT o_orderkey % 50 artifact, md5(CASE WHEN o_orderkey % 50 < 5 THEN o_orderstatus ELSE 'same' END) digest FROM orders) GROUP BY 1 HAVING count(DISTINCT digest) > 1")
def j17(spark, d):
    k = F.col("o_orderkey") % 50
    arms = table(spark, d, "orders").select(F.col("o_orderkey").alias("arm"), k.alias("artifact"), F.md5(F.when(k < 5, F.col("o_orderstatus")).otherwise("same").cast("binary")).alias("digest"))
    return sampling.identity_faults(arms)


@query("j20_s8_evidence_state", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'absent_at_run' WHEN b.k IS NULL THEN 'missing' WHEN a.h <> b.h THEN 'swapped' ELSE 'ok' END state FROM (SELECT o_orderkey k, o_orderstatus h FROM orders WHERE o_orderkey % 7 <> 0) a FULL JOIN (SELECT o_orderkey k, CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE o_orderstatus END h FROM orders WHERE o_orderkey % 5 <> 0) b USING (k)) GROUP BY 1")
def j20(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    was = o.where(k % 7 != 0).select(k.alias("path"), F.col("o_orderstatus").alias("digest"))
    now = o.where(k % 5 != 0).select(k.alias("path"), F.when(k % 13 == 0, "x").otherwise(F.col("o_orderstatus")).alias("digest"))
    return sampling.evidence_state(was, now).groupBy("state").agg(F.count("*").alias("n"))


_FIELD_AT = "[" + ", ".join(f"'{n}'" for n in (*V.NAMES, "colour")) + "]"


@query("j18_suggestion_validity", f"""WITH s AS (SELECT o_orderkey id, CASE o_orderkey % 4 WHEN 0 THEN 'relax' WHEN 1 THEN 'tighten' WHEN 2 THEN 'relax' ELSE 'guess' END action, ({_FIELD_AT})[o_orderkey % 11 + 1] field, o_custkey + o_orderkey % 2 * 100000000 cite, 150 + o_orderkey % 100 len FROM orders)
SELECT CASE WHEN action = 'guess' THEN 'unknown_action' WHEN field = 'colour' THEN 'unknown_field' WHEN cite NOT IN (SELECT c_custkey FROM customer) THEN 'unknown_note' WHEN len > 200 THEN 'too_long' END AS refused, count(*) AS n FROM s GROUP BY 1""")
def j18(spark, d):
    k = F.col("o_orderkey")
    at = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    rows = table(spark, d, "orders").select(
        k.alias("id"), at(["relax", "tighten", "relax", "guess"], k % 4).alias("action"), at([*V.NAMES, "colour"], k % 11).alias("field"),
        F.array(F.col("o_custkey") + k % 2 * 100_000_000).alias("cites"), F.repeat(F.lit("x"), (150 + k % 100).cast("int")).alias("text"),
    )
    notes = table(spark, d, "customer").select(F.col("c_custkey").alias("note_id"))
    return sampling.valid_suggestions(rows, notes, ("relax", "tighten")).groupBy("refused").agg(F.count("*").alias("n"))


@query("j19_proposals", routed_sql("""SELECT field, strength, n AS slots, CASE WHEN field = 'seller_name' AND strength = 'corroborated' THEN 'already_active' WHEN n < 30 THEN 'not_mined' ELSE 'resolved' END AS outcome FROM (SELECT field, strength, count(*) n FROM routed WHERE policy_id = 'P2' AND route = 'review' GROUP BY 1, 2)"""))
def j19(spark, d):
    """Which cohorts in the queue a proposal may name: mined with enough slots, and not an active rule."""


    mined = routing.route(routable(spark, d), POLICIES[1]).where("route = 'review'").groupBy("field", "strength").agg(F.count("*").alias("slots"))
    active = spark.createDataFrame([(f, s, True) for _, f, _, s in POLICIES[1].cohorts], "field string, strength string, active boolean")
    outcome = F.when(F.col("active"), "already_active").when(F.col("slots") < 30, "not_mined").otherwise("resolved")
    return mined.join(F.broadcast(active), ["field", "strength"], "left").select("field", "strength", "slots", outcome.alias("outcome"))


@query("o3_first_seen", "SELECT doc_id, min(p) AS source, count(*) AS seen FROM (SELECT doc_id, 0 p FROM labels UNION ALL SELECT doc_id, 1 FROM documents) GROUP BY 1")
def o3(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.lit(0).alias("p")).unionByName(table(spark, d, "documents").select("doc_id", F.lit(1).alias("p")))
    first = sampling.first_seen(rows.withColumn("source", F.col("p")), ["doc_id"], "p").select("doc_id", "source")
    return first.join(rows.groupBy("doc_id").agg(F.count("*").alias("seen")), "doc_id")


@query("o1_o2_head_samples", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) r FROM documents) WHERE r <= 5")
def o2(spark, d):
    """The five longest documents of each language; each task keeps its own best first."""
    best = F.slice(F.sort_array(F.collect_list(F.struct(-F.col("n_chars"), "doc_id"))), 1, 5)
    part = table(spark, d, "documents").groupBy("lang", F.pmod(F.hash("doc_id"), F.lit(64)).alias("salt")).agg(best.alias("top"))
    rows = part.select("lang", F.explode("top").alias("x")).groupBy("lang").agg(F.slice(F.sort_array(F.collect_list("x")), 1, 5).alias("top"))
    return rows.select("lang", F.explode("top").alias("x")).select("lang", "x.doc_id")


@query("r8_blind_tasks", routed_sql("SELECT doc_id, field, tier FROM routed WHERE policy_id = 'P1' AND route = 'review'"))
def r8(spark, d):
    return sampling.blind(routed(spark, d).where("policy_id = 'P1' AND route = 'review'"), ("doc_id", "field", "tier"))


@query("r10_routing_report", routed_sql("SELECT policy_id, sha256('policy|' || policy_id) AS policy_digest, count(*) AS routes, count(rule_id) AS by_rule FROM routed GROUP BY 1, 2"))
def r10(spark, d):
    return routed(spark, d).groupBy("policy_id", F.sha2(F.concat(F.lit("policy|"), "policy_id"), 256).alias("policy_digest")).agg(F.count("*").alias("routes"), F.count("rule_id").alias("by_rule"))


@query("s9_discover", """WITH p AS (SELECT page_id, '/in/' || page_id % 40 || '/' || CASE page_id % 5 WHEN 0 THEN 'Scan (' || page_id % 20 || ').PDF' WHEN 1 THEN 'invoice_' || page_id || '.pdf' WHEN 2 THEN 'a b.png' WHEN 3 THEN 'note.txt' ELSE 'X--' || page_id || '.jpg' END || '' path FROM pages),
s AS (SELECT DISTINCT path, trim(regexp_replace(lower(regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '-') slug FROM p WHERE lower(path) NOT LIKE '%.txt'),
n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY path) n FROM s) SELECT path, CASE WHEN n > 1 THEN slug || '-' || n ELSE slug END AS doc_id FROM n""")
def s9(spark, d):
    k = F.col("page_id")
    s = lambda x: x.cast("string")
    name = F.when(k % 5 == 0, F.concat(F.lit("Scan ("), s(k % 20), F.lit(").PDF"))).when(k % 5 == 1, F.concat(F.lit("invoice_"), s(k), F.lit(".pdf"))).when(k % 5 == 2, "a b.png").when(k % 5 == 3, "note.txt").otherwise(F.concat(F.lit("X--"), s(k), F.lit(".jpg")))
    return readers.discover(table(spark, d, "pages").select(F.concat(F.lit("/in/"), s(k % 40), F.lit("/"), name).alias("path")).distinct())


@query("s3_s4_responses", """SELECT event_type, count(*) AS stored, count_if(event_id % 10 <> 0 AND event_id % 17 <> 0) AS usable, count(DISTINCT CASE WHEN event_id % 10 <> 0 AND event_id % 17 <> 0 THEN user_id END) AS users FROM events GROUP BY 1""")
def s3(spark, d):
    """Stored calls with a status and a JSON body, some failed and some cut short."""
    e, i = table(spark, d, "events"), F.col("event_id")
    body = F.when(i % 17 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    parsed = F.from_json(body, "k INT, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = e.select("event_type", "user_id", F.when(i % 10 == 0, 500).otherwise(200).alias("http_status"), parsed.alias("b"))
    usable = (F.col("http_status") == 200) & F.col("b._corrupt").isNull()
    return rows.groupBy("event_type").agg(F.count("*").alias("stored"), F.count_if(usable).alias("usable"), F.count_distinct(F.when(usable, F.col("user_id"))).alias("users"))


def _reading_lines(spark, d):
    k = F.col("doc_id")
    rows = base.readings(base.long(base.wide(spark, d)))
    line = F.when(k % 50 == 0, F.col("field")).otherwise(F.concat_ws("\t", k.cast("string"), F.when(k % 43 == 0, "colour").otherwise(F.col("field")), F.coalesce("value", F.lit("")), F.when(k % 3 == 0, "Label").otherwise("")))
    return rows.select(line.alias("value"), (k * 100 + F.col("ord")).alias("ord"), "reader")


_READ = """rl AS (SELECT doc_id, field, reader, value, doc_id % 50 = 0 OR doc_id % 43 = 0 bad FROM readings)"""


@query("s5_s12_readings", base.with_sql("readings", "SELECT reader, count_if(NOT bad) AS kept, count_if(bad) AS malformed, count_if(NOT bad AND value IS NOT NULL AND value <> 'ABSTAIN') AS live, count_if(NOT bad AND doc_id % 3 = 0) AS labelled FROM rl GROUP BY 1", _READ))
def s5(spark, d):
    kept, bad = readers.parse_readings(_reading_lines(spark, d), F.col("reader"))
    good = kept.groupBy("reader").agg(F.count("*").alias("kept"), F.count("value").alias("live"), F.count_if(F.col("label") == "Label").alias("labelled"))
    return good.join(bad.groupBy("reader").agg(F.count("*").alias("malformed")), "reader").select("reader", "kept", "malformed", "live", "labelled")


@query("s6_truth_reader", "SELECT l_returnflag AS field, count(*) AS docs FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber % 3 <> 0 AND l_returnflag IN ('A', 'R')) GROUP BY 1")
def s6(spark, d):
    """Lines as annotations of an order, of which blank ones say nothing."""
    item = F.struct(F.col("l_returnflag").alias("fieldtype"), F.when(F.col("l_linenumber") % 3 != 0, "x").otherwise(" ").alias("text"))
    notes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(item).alias("field_extractions"))
    found, _ = readers.truth(notes, spark.createDataFrame([("A", "A"), ("R", "R")], "fieldtype string, field string"))
    return found.groupBy("field").agg(F.count("*").alias("docs"))


@query("s10_s13_inject", """WITH r AS (SELECT o_custkey doc_id, ({0})[o_orderkey % 11 + 1] field, CASE WHEN o_orderkey % 9 = 0 THEN 'abstain' ELSE 'v' END v FROM orders),
j AS (SELECT *, CASE WHEN field = 'colour' THEN 'unknown_field' WHEN v = 'abstain' THEN 'no_value' END reason FROM r)
SELECT coalesce(reason, 'written') AS outcome, CASE WHEN reason IS NULL THEN count(DISTINCT doc_id || field) ELSE count(*) END AS n FROM j WHERE reason IS NOT NULL OR NOT (doc_id % 4 = 0 AND field = 'total_net') GROUP BY reason""".format(_FIELD_AT))
def s10(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.get(F.array(*[F.lit(n) for n in (*V.NAMES, "colour")]), (k % 11).cast("int")).alias("field"), F.when(k % 9 == 0, "abstain").otherwise("v").alias("value"))
    had = table(spark, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("doc_id"), F.lit("total_net").alias("field"), F.lit("m").alias("tag"))
    fresh, dropped = readers.inject(rows, had, "m")
    return fresh.select(F.lit("written").alias("outcome")).union(dropped.select("reason")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("s14_role_fallback", "SELECT 'seller_name' AS field, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 5 <> 0 UNION ALL SELECT 'buyer_name', count(*) FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 7 = 0")
def s14(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        k.alias("doc_id"), F.when(k % 3 != 0, "s").otherwise(" ").alias("seller"), F.when(k % 5 != 0, "t").alias("station"), F.when(k % 2 == 0, "b").alias("buyer"), F.lit("ABSTAIN").alias("agency"), F.when(k % 7 == 0, "a").alias("advertiser")
    )
    return readers.role_suggestions(rows).groupBy("field").agg(F.count("*").alias("n"))


def _letters(spark, d):
    """Each order as lines of a letter with dates, a term, amounts and parties."""
    k, when = F.col("o_orderkey"), F.col("o_orderdate")
    s = lambda x: x.cast("string")
    date = F.when(k % 4 == 0, F.date_format(when, "MMMM d, yyyy")).when(k % 4 == 1, F.date_format(when, "d MMMM yyyy")).when(k % 4 == 2, F.date_format(when, "MM/dd/yyyy")).otherwise("soon")
    n = s(k % 60)
    term = F.get(F.array(
        F.lit("P/N 30"), F.lit("Net 30 EOM"), F.lit("Terms: net 30"), F.concat(F.lit("due in "), n, F.lit(" days")), F.lit("net 30, 45 days"), F.lit("2/10 n/45"), F.lit("Cash with order"),
        F.concat(n, F.lit(" days after receipt")), F.lit("Due upon receipt"), F.lit("See terms"),
    ), (k % 10).cast("int"))
    second = F.when(k % 30 == 12, "Payable within 20 days").otherwise("Thank you")
    amount = F.concat(s(k), F.lit(".25"))
    lines = [
        F.concat(F.lit("Invoice Date: "), date), term, second, F.concat(F.lit("Date received: "), F.when(k % 20 == 8, "unknown").otherwise(F.date_format(when, "MMM d yyyy"))),
        F.concat(F.lit("Agency commission 1.00 Gross billings $"), amount), F.lit("Amount due"), F.concat(F.lit("7.00 or "), amount), F.concat(F.lit("Net due "), F.when(k % 8 == 0, "9.99").otherwise(amount)),
        F.lit("Sold to:"), F.concat(F.lit("Customer "), s(F.col("o_custkey"))), F.when(k % 6 == 0, "Attn Media").otherwise("Trading"), F.lit("12 High Street"),
        F.lit("Please remit to"), F.when(k % 6 == 1, "Media Agency").otherwise(F.concat(F.lit("Station "), n)), F.lit("Springfield, IL 62701"), F.when(k % 9 == 0, "Payee").otherwise("."),
    ]
    return table(spark, d, "orders").select(k.alias("doc_id"), F.posexplode(F.array(*lines)).alias("line_idx", "line"))


_DUE = """o AS (SELECT o_orderkey k, CAST(o_orderdate AS DATE) d, o_orderkey % 4 = 2 AND day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) amb FROM orders),
t AS (SELECT *, CASE WHEN k % 10 IN (7, 8) THEN 'receipt' WHEN k % 10 IN (0, 1, 9) THEN NULL ELSE 'invoice' END b,
 CASE k % 10 WHEN 2 THEN 30 WHEN 3 THEN k % 60 WHEN 4 THEN 30 WHEN 5 THEN 45 WHEN 6 THEN 0 WHEN 7 THEN k % 60 WHEN 8 THEN 0 END n FROM o),
r AS (SELECT *, CASE WHEN k % 10 = 1 THEN 'term_end_of_month' WHEN k % 30 = 12 THEN 'term_several' WHEN b IS NULL THEN 'no_term'
 WHEN b = 'receipt' AND k % 20 = 8 THEN 'no_receipt_date' WHEN b = 'invoice' AND k % 4 = 3 THEN 'no_invoice_date' WHEN b = 'invoice' AND amb THEN 'date_ambiguous' END reason FROM t)"""


@query("f7_p5_p6_p7_due_dates", f"WITH {_DUE} SELECT k AS doc_id, CASE WHEN reason IS NULL THEN CAST(d + CAST(n AS INT) AS DATE) END AS due, CASE WHEN reason IS NULL OR reason NOT LIKE 'term%' THEN b END AS base, reason FROM r")
def f7(spark, d):
    return dates.derive_due(_letters(spark, d))


_AMOUNTS = """am AS (SELECT o_orderkey doc_id, 'total_gross' field, '$' || o_orderkey || '.25' AS value FROM orders UNION ALL SELECT o_orderkey, 'amount_due', o_orderkey || '.25' FROM orders WHERE o_orderkey % 8 <> 0)"""


@query("f14_p9_amount_labels", f"WITH {_AMOUNTS} SELECT * FROM am")
def p9(spark, d):
    return blocks.bind_amounts(_letters(spark, d))


_PARTIES = """pa AS (SELECT o_orderkey doc_id, 'buyer_name' field, 'Customer ' || o_custkey || CASE WHEN o_orderkey % 6 = 0 THEN ' Attn Media' ELSE ' Trading' END AS value FROM orders
UNION ALL SELECT o_orderkey, 'seller_name', 'Station ' || o_orderkey % 60 FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 6 <> 1)"""


@query("f15_p8_party_blocks", f"WITH {_PARTIES} SELECT * FROM pa")
def p8(spark, d):
    return blocks.suggest_parties(_letters(spark, d))


@query("s15_suggestions", base.with_sql("m2", f"""SELECT source, field, count(*) AS n, count(value) AS said FROM (SELECT 'derived_due' source, 'due_date' field, CASE WHEN reason IS NULL THEN 'x' END AS value FROM r
 UNION ALL SELECT 'second_mode', field, CASE WHEN trim(value) <> '' AND upper(trim(value)) <> 'ABSTAIN' THEN value END FROM m2 UNION ALL SELECT 'amount_label', field, value FROM am UNION ALL SELECT 'party_block', field, value FROM pa) GROUP BY 1, 2""", f"{_DUE}, {_AMOUNTS}, {_PARTIES}"))
def s15(spark, d):
    """All sources of suggestions beside the first response, counted with what they say."""
    second = base.mode2(base.long(base.wide(spark, d)))
    return blocks.suggestions(_letters(spark, d), second).groupBy("source", "field").agg(F.count("*").alias("n"), F.count("value").alias("said"))


@query("g9_class_evidence", """WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'invoice' WHEN 1 THEN 'contract' WHEN 2 THEN NULL ELSE 'else' END cls, contains(lower(text), 'the') seen_invoice, contains(lower(text), 'und') seen_contract FROM documents)
SELECT CASE WHEN cls IS NULL THEN 'no_claim' WHEN cls = 'else' THEN 'unmapped' WHEN doc_id % 13 = 0 THEN 'ocr_unavailable' WHEN (cls = 'invoice' AND seen_invoice) OR (cls = 'contract' AND seen_contract) THEN 'pass' ELSE 'fail' END AS status, count(*) AS n FROM c GROUP BY 1""")
def g9(spark, d):
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    claims = docs.select("doc_id", F.when(k % 4 == 0, "An invoice").when(k % 4 == 1, "Agreement").when(k % 4 == 3, "else").alias("claimed"))
    low = F.lower("text")
    seen = docs.where(low.contains("the")).select("doc_id", F.lit("invoice").alias("doc_class")).union(docs.where(low.contains("und")).select("doc_id", F.lit("contract")))
    return blocks.class_check(claims, seen, docs.where("doc_id % 13 <> 0")).groupBy("status").agg(F.count("*").alias("n"))


@query("j3_span_containment", """WITH n AS (SELECT count(*) n FROM documents), dr AS (SELECT DISTINCT item_id draft_id, unnest([item_id * 7 % n, item_id * 3 % n]) doc_id, text FROM benchmark, n),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 span FROM documents WHERE doc_id IN (SELECT doc_id FROM dr)),
own AS (SELECT DISTINCT draft_id, doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) tok FROM dr), w AS (SELECT draft_id, doc_id, count(*) wanted FROM own GROUP BY 1, 2),
hay AS (SELECT DISTINCT doc_id, span, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) tok FROM l)
SELECT draft_id, doc_id, span, count(*) AS matched, wanted FROM own JOIN hay USING (doc_id, tok) JOIN w USING (draft_id, doc_id) GROUP BY 1, 2, 3, 5 HAVING count(*) >= 0.3 * wanted""")
def j3(spark, d):
    """Lines of a draft's own document that hold three tenths of its tokens; drafts as in the binding queries."""
    n = table(spark, d, "documents").count()
    i = F.col("item_id")
    drafts = table(spark, d, "benchmark").select(i.alias("draft_id"), F.explode(F.array(i * 7 % n, i * 3 % n)).alias("doc_id"), F.col("text").alias("value")).distinct()
    own = table(spark, d, "documents").join(drafts.select("doc_id").distinct(), "doc_id", "left_semi")
    return text.covering_spans(drafts, text.lines(own).select("doc_id", F.col("line_idx").alias("span"), F.col("line").alias("text")), 0.3)


@query("r11_second_mode", base.with_sql("wide", "SELECT requirement, count(*) AS docs FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'required' WHEN invoice_number IS NULL OR total_gross IS NULL OR total_vat IS NULL OR seller_vat_id IS NULL THEN 'escalated' ELSE 'optional_skipped' END requirement FROM wide) GROUP BY 1"))
def r11(spark, d):
    risk = F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in V.TIER1]))
    need = F.when(F.col("doc_id") % 3 == 0, "required").when(F.size(risk) > 0, "escalated").otherwise("optional_skipped")
    return base.wide(spark, d).groupBy(need.alias("requirement")).agg(F.count("*").alias("docs"))


@query("s11_write_once", "SELECT o_orderstatus AS status, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, true AS refused FROM orders GROUP BY 1")
def s11(spark, d):
    """An artifact of all orders; a second writer of the same artifact is refused and changes nothing."""
    rows = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("orders"), F.sum(base.cents(F.col("o_totalprice"))).alias("cents"))
    path, refused = f"{tables.shared_folder(spark)}/slotforge-artifact-{uuid.uuid4().hex}", False
    readers.write_once(rows, path)
    try:
        readers.write_once(rows.withColumn("orders", F.lit(0).cast("long")), path)
    except readers.AlreadyWritten:
        refused = True
    return readers.read_once(spark, path).withColumn("refused", F.lit(refused))
