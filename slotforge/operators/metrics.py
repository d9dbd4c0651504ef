"""Measures against truth (ids A9-A12, A15-A24, A28-A31, V5-V9, J14 of the survey).

A document without a truth record is unscored; one whose record lacks the field says that the field is absent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotforge.functions import values as V
from slotforge.operators import ordered, routing, tables, text


def with_truth(slots: DataFrame, truth: DataFrame | None, truth_docs: DataFrame | None) -> DataFrame:
    """The slots with ``want`` (null: absent) and ``scored`` (the document has a record); without the two tables they have
    these columns."""
    if truth is None:
        return slots
    known = truth_docs.select("doc_id", F.lit(True).alias("scored"))
    return slots.join(truth, ["doc_id", "field"], "left").join(known, "doc_id", "left").withColumn("scored", F.coalesce("scored", F.lit(False)))


def silent_counts() -> dict[str, Column]:
    """What automation let through: values that truth has and it called absent, and values that truth contradicts."""
    scored, route = F.col("scored"), F.col("route")
    absent, value = scored & (route == "auto_absent"), scored & (route == "auto_accept")
    return {
        "slots": F.count("*"), "unscored": F.count_if(~scored), "review": F.count_if(route == "review"), "absent_hits": F.count_if(absent),
        "silent_absent": F.count_if(absent & F.col("want").isNotNull()), "value_hits": F.count_if(value), "silent_wrong": F.count_if(value & ~F.col("v").eqNullSafe(F.col("want"))),
    }


def silent_errors(rows: DataFrame, *by: str) -> DataFrame:
    """The silent errors of each group."""
    return rows.groupBy(*by).agg(*[c.alias(n) for n, c in silent_counts().items()])


def compare(rows: DataFrame, systems: dict[str, Column]) -> DataFrame:
    """For each accept rule: coverage, silent errors split in wrong and missing, recall of routing, whole documents released."""
    table = F.array(*[F.struct(F.lit(n).alias("system"), c.alias("accept")) for n, c in systems.items()])
    flat = rows.select("doc_id", "deviation", "wrong", F.inline(table))
    docs = flat.groupBy("system", "doc_id").agg(
        F.count("*").alias("n"), F.count_if("deviation").alias("dev"), F.count_if("accept").alias("acc"), F.count_if(F.col("accept") & F.col("deviation")).alias("silent"),
        F.count_if(F.col("accept") & F.col("wrong")).alias("silent_wrong"), F.bool_and("accept").alias("released"),
    )
    return docs.groupBy("system").agg(
        F.sum("n").alias("slots"), F.sum("dev").alias("deviations"), F.sum("acc").alias("accepted"), F.sum("silent").alias("silent"), F.sum("silent_wrong").alias("silent_wrong"),
        F.count_if("released").alias("docs_released"), F.count_if(F.col("released") & (F.col("silent") > 0)).alias("docs_silent"),
    )


def recall_at_budgets(rows: DataFrame, order: list[Column], percents: list[int]) -> DataFrame:
    """(percent, reviewed, found, total): deviations among the first so many per cent of slots in the order."""
    rows = tables.cut(rows.select("deviation", *[c.alias(f"__o{i}") for i, c in enumerate(order)]))
    placed = routing.ranked(rows, *[F.col(f"__o{i}") for i in range(len(order))])
    total = rows.agg(F.count("*").alias("n"), F.count_if("deviation").alias("total"))
    budget = F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")
    hit = placed.select("position", "deviation").crossJoin(F.broadcast(total)).select("*", budget)  # one row of totals
    inside = F.col("position") < F.floor(F.col("n") * F.col("percent") / 100)
    return hit.groupBy("percent").agg(F.count_if(inside).alias("reviewed"), F.count_if(inside & F.col("deviation")).alias("found"), F.max("total").alias("total"))


def tie_range(rows: DataFrame, percents: list[int]) -> DataFrame:
    """(percent, best, worst): deviations found if the cut falls inside a group of equal confidence.

    Groups of equal confidence (as many as rows, for real scores) are counted, and their counts run over ranges of it.
    """
    groups = rows.groupBy(F.coalesce("confidence", F.lit(-1)).alias("c")).agg(F.count("*").alias("n"), F.count_if("deviation").alias("d"))
    run = tables.cut(ordered.carried(groups, None, ["c"], ["n", "d"]))
    total = run.agg(F.sum("n").alias("total"))
    cut = run.crossJoin(F.broadcast(total)).select("*", F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")).withColumn("k", F.floor(F.col("total") * F.col("percent") / 100))  # one row of totals
    inside = cut.where((F.col("before_n") < F.col("k")) & (F.col("k") <= F.col("before_n") + F.col("n"))).withColumn("r", F.col("k") - F.col("before_n"))
    return inside.select("percent", (F.col("before_d") + F.least("r", "d")).alias("best"), (F.col("before_d") + F.greatest(F.lit(0), F.col("r") - (F.col("n") - F.col("d")))).alias("worst"))


#: Below which number each count of a Poisson(1) number lies: 0, 1, ... 9 and more.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)])


def poisson_weights(keys: np.ndarray, replicates: int) -> np.ndarray:
    """Weights (keys x replicates) of a bootstrap: Poisson(1) numbers, hashed from a row's 64-bit key and the replicate."""
    x = keys.astype(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) / float(1 << 53), "right")


def bootstrap(docs: DataFrame, replicates: int, hit: str, total: str, key: str = "doc_id") -> DataFrame:
    """(point, low, high) of a share, with a 95 % interval by document: each replicate weighs a document by a hashed
    Poisson(1) number.

    A task keeps one vector of sums for all replicates and gives a row for each at its end; no row is multiplied.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, replicates))
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            values = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2)])
            for at in range(0, len(keys), 256):
                sums += values[:, at : at + 256] @ poisson_weights(keys[at : at + 256], replicates)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(sums[0]), pa.array(sums[1])], ["replicate", "hits", "totals"])

    narrow = docs.select(F.xxhash64(key).alias("key"), *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in (hit, total)])
    vectors = narrow.mapInArrow(run, "replicate long, hits double, totals double")
    share = vectors.groupBy("replicate").agg((F.sum("hits") / F.greatest(F.sum("totals"), F.lit(1.0))).alias("share"))
    bounds = share.agg(F.percentile("share", 0.025).alias("low"), F.percentile("share", 0.975).alias("high"))  # a row for each replicate
    return docs.agg((F.sum(hit) / F.sum(total)).alias("point")).crossJoin(bounds)


def absence_ledger(rows: DataFrame, *by: str) -> DataFrame:
    """Missing values by group: how many are truly absent (saves), silently wrong, unscored; safe with no risk and 3 saves."""
    miss = rows.where("v IS NULL")
    out = miss.groupBy(*by).agg(
        F.count_distinct("doc_id").alias("docs"), F.count_if(F.col("scored") & F.col("want").isNull()).alias("saves"),
        F.count_if(F.col("scored") & F.col("want").isNotNull()).alias("silent"), F.count_if(~F.col("scored")).alias("unscored"),
    )
    return out.withColumn("safe", (F.col("silent") == 0) & (F.col("unscored") == 0) & (F.col("saves") >= 3))


def counterfactual(active: DataFrame, candidate: DataFrame, truth: DataFrame) -> DataFrame:
    """What a candidate policy would change: slots relaxed and tightened by field, and relaxed ones that truth contradicts."""
    auto = lambda c: F.col(c).isin("auto_accept", "auto_absent")
    both = active.select("doc_id", "field", "v", F.col("route").alias("old")).join(candidate.select("doc_id", "field", F.col("route").alias("new")), ["doc_id", "field"]).join(truth, ["doc_id", "field"], "left")
    relaxed = auto("new") & ~auto("old")
    wrong = F.when(F.col("new") == "auto_absent", F.col("want").isNotNull()).otherwise(~F.col("v").eqNullSafe(F.col("want")))
    return both.groupBy("field").agg(
        F.count_if(relaxed).alias("relaxed"), F.count_if(auto("old") & ~auto("new")).alias("tightened"), F.count_if(relaxed & wrong).alias("conflicts"), (F.count_if(~auto("new")) - F.count_if(~auto("old"))).alias("load_delta")
    )


def gate(evaluation: DataFrame) -> DataFrame:
    """(candidate, refusals, basis): all reasons why a candidate policy may not be promoted; none where it may.

    ``evaluation`` has one row for each candidate: class_rules and evidence_rules (how many it has), probes_available,
    rule_truth (``scored`` or why not), rule_conflicts, scored, and silent_absent, silent_wrong and review of the
    baseline (``_old``) and the candidate (``_new``). Without truth only the first checks can refuse. Slots whose truth is
    disputed are in none of these counts.
    """
    rules, rose = (F.col("class_rules") > 0) | ((F.col("evidence_rules") > 0) & F.col("probes_available")), lambda c: F.col("scored") & (F.col(f"{c}_new") > F.col(f"{c}_old"))
    checks = [
        F.when((F.col("evidence_rules") > 0) & ~F.col("probes_available"), "no_absence_probes"), F.when(rules & (F.col("rule_truth") != "scored"), "rules_without_truth"),
        F.when(rules & (F.col("rule_truth") == "scored") & (F.col("rule_conflicts") > 0), "rules_against_truth"),
        *[F.when(rose(c), f"{c}_rose") for c in ("silent_absent", "silent_wrong", "review")],
    ]
    basis = F.when(F.col("scored"), "truth_replay").otherwise("replay_only")
    return evaluation.select("candidate", F.array_join(F.array_compact(F.array(*checks)), ",").alias("refusals"), basis.alias("basis"))


def run_scores(slots: DataFrame, truth: DataFrame | None, truth_docs: DataFrame | None, policies: list[routing.Policy], probes: DataFrame | None = None, disputes: DataFrame | Column | None = None) -> DataFrame:
    """(run, policy_id, probes_available, review, silent_absent, silent_wrong, disputed, scored, hits, rule_conflicts,
    rule_disputes, blind): each run of ``slots`` under each policy, in one pass over the slots.

    ``hits`` are missing values that a rule expects, before sampling; of those with a value in truth, ``rule_disputes``
    are the slots of ``disputes`` (doc_id, field; or a condition), whose truth can be read in two ways, and
    ``rule_conflicts`` the others; so are ``disputed`` and ``silent_absent`` of what was released as absent. ``probes`` (run, available): in a run
    without absence probes no page-evidence rule can match. Without that table all runs have them. ``truth`` and
    ``truth_docs`` are as in ``with_truth``. All joins are made before a slot is multiplied by the policies.
    """
    have = probes.select("run", F.col("available").alias("probes_available")) if probes is not None else None
    rows = slots.join(F.broadcast(have), "run", "left") if have is not None else slots.withColumn("probes_available", F.lit(True))
    rows = rows.withColumn("probes_available", F.coalesce("probes_available", F.lit(False)))
    rows = rows.withColumn("absence_evidence", F.when(F.col("probes_available"), F.col("absence_evidence")))
    rows = with_truth(rows, truth, truth_docs)
    if isinstance(disputes, DataFrame):
        rows = rows.join(disputes.select("doc_id", "field", F.lit(True).alias("__open")).distinct(), ["doc_id", "field"], "left")
    else:
        rows = rows.withColumn("__open", F.lit(False) if disputes is None else disputes)
    rows = routing.route_all(rows, policies, explain=False)
    hit, open_ = (F.col("extraction_present") == "fail") & F.col("rule_id").isNotNull(), F.coalesce("__open", F.lit(False))
    against, absent = F.col("scored") & F.col("want").isNotNull(), F.col("route") == "auto_absent"
    counts = {n: c for n, c in silent_counts().items() if n in ("review", "silent_wrong")} | {
        "silent_absent": F.count_if(absent & against & ~open_), "disputed": F.count_if(absent & against & open_), "hits": F.count_if(hit),
        "rule_conflicts": F.count_if(hit & against & ~open_), "rule_disputes": F.count_if(hit & against & open_), "blind": F.count_if(hit & ~F.col("scored")),
    }
    return rows.groupBy("run", "policy_id").agg(F.bool_and("probes_available").alias("probes_available"), F.bool_or("scored").alias("scored"), *[c.alias(n) for n, c in counts.items()])


def score_new_runs(slots: DataFrame, path: str, *given, **options) -> DataFrame:
    """The scores of all runs, of which those stored at ``path`` are not computed again; new ones are added to it.

    A run's slots do not change once it is written, so its scores hold as long as the policies are the same: there is a
    path for each set of policies. Where ``slots`` lies in folders by run, the slots of stored runs are not read.
    """
    spark = slots.sparkSession
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = None
    fresh = slots if stored is None else slots.join(stored.select("run").distinct(), "run", "left_anti")
    run_scores(fresh, *given, **options).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def against_baseline(scores: DataFrame, baseline: routing.Policy, candidates: list[routing.Policy]) -> DataFrame:
    """The rows that ``gate`` reads: each candidate against the baseline, over all runs of ``run_scores``."""
    measures = ("review", "silent_absent", "silent_wrong", "disputed")
    judged = scores.groupBy("policy_id").agg(*[F.sum(c).alias(c) for c in (*measures, "hits", "rule_conflicts", "rule_disputes", "blind")], F.bool_or("scored").alias("scored"), F.bool_and("probes_available").alias("probes_available"))
    listed = scores.sparkSession.createDataFrame([(p.policy_id, len(p.absent), len(p.evidenced)) for p in candidates], "policy_id string, class_rules int, evidence_rules int")
    old = judged.where(F.col("policy_id") == baseline.policy_id).select(*[F.col(c).alias(f"{c}_old") for c in measures])
    new = judged.join(F.broadcast(listed), "policy_id").select(
        F.col("policy_id").alias("candidate"), "class_rules", "evidence_rules", "probes_available",
        F.when(F.col("hits") == 0, "no_match").when(F.col("blind") > 0, "incomplete").otherwise("scored").alias("rule_truth"), "rule_conflicts", "rule_disputes", "scored", *[F.col(c).alias(f"{c}_new") for c in measures],
    )
    return new.crossJoin(F.broadcast(old))  # one row


def evaluate(slots: DataFrame, truth: DataFrame, truth_docs: DataFrame, baseline: routing.Policy, candidates: list[routing.Policy], probes_available: bool = True, disputes: DataFrame | None = None) -> DataFrame:
    """The rows that ``gate`` reads for slots of one run."""
    probes = slots.sparkSession.createDataFrame([(0, probes_available)], "run int, available boolean")
    scores = tables.cut(run_scores(slots.withColumn("run", F.lit(0)), truth, truth_docs, [baseline, *candidates], probes, disputes))  # a row for each policy
    return against_baseline(scores, baseline, candidates)


def rule_search(slots: DataFrame, truth: DataFrame | None, truth_docs: DataFrame | None, baseline: routing.Policy, fields: tuple[str, ...], empty_rate: float = 0.9) -> DataFrame:
    """(field, saved, cost, empty, documents, gated, blind): what an absence rule on each further field would do.

    Each field's rule is added to the baseline alone; all are routed in one pass, and slots meet their truth (as in
    ``with_truth``) before they are multiplied by the rules. ``gated``: it lowers review and adds no silent absence.
    ``blind``: without truth, the field is missing in so large a share of documents.
    """
    have = {r[1] for r in baseline.absent}
    tried = [n for n in fields if n not in have]
    arms = [replace(baseline, policy_id=f"+{n}", absent=(*baseline.absent, (f"try_{n}", n))) for n in tried]
    rows = routing.route_all(with_truth(slots, truth, truth_docs), [baseline, *arms], explain=False)
    counts = {n: c for n, c in silent_counts().items() if n in ("review", "silent_absent")}
    scores = tables.cut(rows.groupBy("policy_id", "field").agg(*[c.alias(n) for n, c in counts.items()], F.count_if(F.col("extraction_present") == "fail").alias("empty"), F.count("*").alias("documents")))  # a row for each rule and field
    whole = scores.groupBy("policy_id").agg(F.sum("review").alias("review"), F.sum("silent_absent").alias("silent_absent"))
    own = F.col("policy_id") == baseline.policy_id
    base = whole.where(own).select(F.col("review").alias("r0"), F.col("silent_absent").alias("s0"))
    empty = scores.where(own).select("field", "empty", "documents")
    out = whole.where(~own).crossJoin(F.broadcast(base)).select(F.substring("policy_id", 2, 100).alias("field"), (F.col("r0") - F.col("review")).alias("saved"), (F.col("silent_absent") - F.col("s0")).alias("cost"))
    return out.join(empty, "field").select("*", ((F.col("saved") > 0) & (F.col("cost") <= 0)).alias("gated"), (F.col("empty") >= empty_rate * F.col("documents")).alias("blind"))


#: Between which bounds each measure of triage should lie.
BANDS = {"H1_lift": (1.5, None), "H2_coverage": (0.55, None), "H3_recall": (0.55, None), "H4_missing": (0.10, 0.45), "H5_citation": (None, 0.15), "H6_refusal": (0.05, 0.35)}


def triage_quality(placed: DataFrame, drafts: DataFrame, share: float = 0.46) -> DataFrame:
    """(metric, value, within): H1 to H6 with their bands; a measure without a base is null and not within.

    ``placed``: slots in queue order with position, deviation, scored, route, disputed and gates; disputed and unscored
    slots count for H4 and H5 only. ``drafts`` has ``outcome``. All is counted in one pass over each table.
    """
    use = F.col("scored") & ~F.col("disputed")
    n = placed.where(use).agg(F.count("*").alias("n"))
    order = routing.ranked(placed.where(use).select(F.col("position").alias("__p"), "deviation", "route"), F.col("__p"))
    half, most, p, dev = F.floor(F.col("n") / 2), F.floor(F.col("n") * share), F.col("position"), F.col("deviation")
    one = order.crossJoin(F.broadcast(n)).agg(
        F.max(half).alias("half"), F.max(F.col("n") - half).alias("rest"), F.count_if((p < half) & dev).alias("front"), F.count_if((p >= half) & dev).alias("back"), F.count_if((p < most) & dev).alias("early"),
        F.count_if(F.col("route").isin("review", "block") & dev).alias("queued"), F.count_if(dev).alias("deviations"),
    )
    two = placed.agg(F.count("*").alias("slots"), F.count_if(F.col("extraction_present") == "fail").alias("missing"), F.count_if(F.col("citation_holds") == "fail").alias("uncited"), F.count_if(F.col("citation_holds").isin("pass", "fail")).alias("citable"))
    three = drafts.agg(F.count("*").alias("drafts"), F.count_if(F.col("outcome") != "admitted").alias("refused"))
    per = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    values = {
        "H1_lift": per("front", "half") / F.nullif(per("back", "rest"), F.lit(0.0)), "H2_coverage": per("early", "deviations"), "H3_recall": per("queued", "deviations"),
        "H4_missing": per("missing", "slots"), "H5_citation": per("uncited", "citable"), "H6_refusal": per("refused", "drafts"),
    }
    bounds = lambda v, low, high: (v >= low if low is not None else F.lit(True)) & (v < high if high is not None else F.lit(True))
    rows = [F.struct(F.lit(m).alias("metric"), v.alias("value"), F.coalesce(bounds(v, *BANDS[m]), F.lit(False)).alias("within")) for m, v in values.items()]
    return one.crossJoin(two).crossJoin(three).select(F.inline(F.array(*rows)))  # one row each


def paired_confusion(first: DataFrame, second: DataFrame, axis: tuple[str, ...]) -> DataFrame:
    """(a, b, slots) for all pairs of the axis and ``unpaired``: how two reviewers decided the same slots. Both tables have
    target and decision; a slot that one of them left out is unpaired on that side."""
    both = first.select("target", F.col("decision").alias("a")).join(second.select("target", F.col("decision").alias("b")), "target", "full_outer")
    counts = both.groupBy(F.coalesce("a", F.lit("unpaired")).alias("a"), F.coalesce("b", F.lit("unpaired")).alias("b")).agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(x) for x in (*axis, "unpaired")])
    grid = first.sparkSession.range(1).select(F.explode(names).alias("a")).select("a", F.explode(names).alias("b"))  # a fixed grid
    return grid.join(F.broadcast(counts), ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("slots")).where("NOT (a = 'unpaired' AND b = 'unpaired')")


#: Fields that may print one total twice, and words that mark a date of another kind.
TOTALS, OTHER_DATES = ("total_net", "total_vat", "total_gross"), ("transaction", "donation", "authorization", "adjustment")


def caliber_disputes(truth: DataFrame, stream: DataFrame, reach: int = 12) -> DataFrame:
    """(doc_id, field, kind) of slots whose truth may be read in two ways.

    T1: a total whose true amount is that of the amount due. T2(i): the due date stands on the page and is the issue date;
    T2(ii): it stands there within ``reach`` words of a word for another kind of date. ``truth`` has doc_id, field, value;
    ``stream`` the page's tokens. Where the page does not print the date, nothing is said.
    """
    due = truth.where("field = 'amount_due'").select("doc_id", V.amount(F.col("value")).alias("__due"))
    t1 = truth.where(F.col("field").isin(*TOTALS)).join(due, "doc_id").where(V.amount(F.col("value")) == F.col("__due")).select("doc_id", "field", F.lit("T1").alias("kind"))
    said = lambda name, out: truth.where(F.col("field") == name).select("doc_id", V.tokens(F.col("value")).alias(out))
    dates = said("due_date", "toks").where("size(toks) > 0").join(said("issue_date", "issue"), "doc_id", "left")
    # the document's own date among its tokens: the first token proposes, the others are checked one by one
    start = dates.select("doc_id", "toks", "issue", F.get("toks", F.lit(0)).alias("tok")).join(stream, ["doc_id", "tok"])
    rest = start.select("doc_id", "pos", F.size("toks").alias("n"), F.posexplode("toks").alias("k", "tok")).withColumn("at", F.col("pos") + F.col("k"))
    met = rest.join(stream.withColumnRenamed("pos", "at"), ["doc_id", "at", "tok"]).groupBy("doc_id", "pos", "n").agg(F.count("*").alias("m")).where("m = n").drop("m")
    near = text.near_terms(stream, met.withColumn("phrase_id", F.lit("due")), list(OTHER_DATES), reach).groupBy("doc_id").agg(F.bool_or("in_context").alias("near"))
    kind = F.when(F.col("issue") == F.col("toks"), "T2(i)").when(F.col("near"), "T2(ii)")
    t2 = dates.join(near, "doc_id").select("doc_id", F.lit("due_date").alias("field"), kind.alias("kind")).where("kind IS NOT NULL")
    return t1.unionByName(t2)


def side_accuracy(points: DataFrame, labels: DataFrame, reach: float, kill: int = 80) -> DataFrame:
    """(variant, n, correct, skipped, survives): how often the nearest label tells a point's side, by variant of the rule.

    ``points`` has point_id, page, x, y, truth; ``labels`` label_id, page, side, x, y. A point without a label that the
    variant admits is skipped. ``nearest``: of all; ``within``: none further than ``reach``; ``closer``: both sides stand
    on the page, and the nearer one is taken. A variant survives with ``kill`` of 100 correct.
    """
    own, total = points.select("point_id", "truth"), points.agg(F.count("*").alias("total"))
    near = text.nearest(points, labels)
    sides = labels.select("page", "side").distinct().groupBy("page").agg(F.count("*").alias("__sides"))
    both = points.join(sides.where("__sides > 1"), "page", "left_semi").select("point_id")
    variants = {"nearest": near, "within": near.where(F.col("distance2") <= reach * reach), "closer": near.join(both, "point_id", "left_semi")}
    rows = reduce(lambda a, b: a.unionByName(b), [f.join(own, "point_id").select(F.lit(v).alias("variant"), (F.col("side") == F.col("truth")).alias("ok")) for v, f in variants.items()])
    out = rows.groupBy("variant").agg(F.count("*").alias("n"), F.count_if("ok").alias("correct")).crossJoin(F.broadcast(total))
    return out.select("variant", "n", "correct", (F.col("total") - F.col("n")).alias("skipped"), (100 * F.col("correct") >= kill * F.col("n")).alias("survives"))
