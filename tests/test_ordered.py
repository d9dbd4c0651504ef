"""Running sums, predecessors and quantiles over ranges, against plain Python; a key with most rows in many tasks."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F
from slotforge.operators import ledger, metrics, ordered

SCHEMA = "k long, o long, n long, v string"


def made(seed, size):
    rng = random.Random(seed)
    return [(rng.choice([1] * 6 + [2, 3, None]), i, rng.choice([rng.randrange(9), None]), rng.choice([f"v{i}", None])) for i in range(size)]


@pytest.fixture(autouse=True)
def many_ranges(spark):
    # else so few rows would be one range
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("size", [0, 1, 5, 400])
def test_carried(spark, size):
    rows = made(size, size)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    found = ordered.carried(spark.createDataFrame(shuffled, SCHEMA), "k", ["o"], ["n"], "v").collect()
    sums, last, want = {}, {}, {}
    for k, o, n, v in rows:
        want[o] = (k, sums.get(k, 0), last.get(k))
        sums[k], last[k] = sums.get(k, 0) + (n or 0), v
    assert {r.o: (r.k, r.before_n, r.before) for r in found} == want


def test_carried_without_a_key(spark):
    rows = made(3, 200)
    found = {r.o: r.before_n for r in ordered.carried(spark.createDataFrame(rows, SCHEMA).repartition(5), None, ["o"], ["n"]).collect()}
    total = 0
    for _, o, n, _ in rows:
        assert found[o] == total
        total += n or 0


def test_a_key_lies_in_many_tasks_and_no_window_is_without_partition(spark):
    df = spark.createDataFrame([(1, i, 1, f"v{i}") for i in range(2000)], SCHEMA)
    out = ordered.carried(df, "k", ["o"], ["n"], "v")
    assert out.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1
    assert "windowspecdefinition(o" not in out._jdf.queryExecution().analyzed().toString().replace(" ", "")


@pytest.mark.parametrize("size", [1, 2, 7, 300])
def test_quantiles(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(12)])) for _ in range(size)]
    found = {r.k: (r.n, r.median, r.high) for r in ordered.quantiles(spark.createDataFrame(rows, "k long, x long"), "k", "x", {"median": 0.5, "high": 0.9}).collect()}
    for k in {r[0] for r in rows}:
        own = [x for g, x in rows if g == k and x is not None]
        if own:
            assert found[k][0] == len(own) and found[k][1] == statistics.median(own)
            assert abs(found[k][2] - np.quantile(own, 0.9)) < 1e-9


def test_one_long_chain(spark):
    rows = [("long", i, f"d{i}", f"d{i - 1}" if i else None) for i in range(1500)] + [(f"c{i}", j, f"{i}/{j}", f"{i}/{j - 1}" if j else None) for i in range(30) for j in range(5)]
    rows[700] = ("long", 700, "d700", "other")
    rows[900] = ("long", 9000, "d900", "d899")  # out of place: its own number, and its neighbours' links
    rows += [(None, 0, "n", None), ("c0", 7, "late", "0/4")]
    random.Random(4).shuffle(rows)
    found = {r.chain_id: (r.entries, r.broken) for r in ledger.hash_chain(spark.createDataFrame(rows, "chain_id string, seq long, digest string, previous string")).collect()}
    chains = {}
    for c, seq, digest, previous in sorted(rows, key=lambda r: r[1:3]):
        own = chains.setdefault(c, [0, 0, None])
        own[1] += previous != own[2] or seq != own[0]
        own[0], own[2] = own[0] + 1, digest
    assert found == {c: tuple(v[:2]) for c, v in chains.items()} and found["long"][1] > 500


def test_tie_range_of_unlike_scores(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, rng.random()]), rng.random() < 0.3) for _ in range(500)]
    found = {r.percent: (r.best, r.worst) for r in metrics.tie_range(spark.createDataFrame(rows, "confidence double, deviation boolean"), [10, 50, 90]).collect()}
    groups = {}
    for c, d in rows:
        groups.setdefault(-1 if c is None else c, []).append(d)
    for percent, got in found.items():
        left, best, worst = len(rows) * percent // 100, 0, 0
        for c in sorted(groups):
            take, d = min(left, len(groups[c])), sum(groups[c])
            best, worst, left = best + min(take, d), worst + max(0, take - (len(groups[c]) - d)), left - take
        assert got == (best, worst)
    assert len(found) == 3


def test_bootstrap_is_like_resampling_and_multiplies_no_rows(spark):
    rng = np.random.default_rng(3)
    total = rng.integers(1, 6, 400)
    hit = rng.binomial(total, 0.2)
    docs = spark.createDataFrame([(i, int(h), int(t)) for i, (h, t) in enumerate(zip(hit, total, strict=True))], "doc_id long, d long, n long").repartition(5)
    r = metrics.bootstrap(docs, 1000, "d", "n").first()
    draws = rng.integers(0, 400, (4000, 400))
    low, high = np.quantile(hit[draws].sum(1) / total[draws].sum(1), [0.025, 0.975])
    assert r.point == hit.sum() / total.sum()
    assert abs(r.low - low) < 0.008 and abs(r.high - high) < 0.008
    assert "Generate" not in metrics.bootstrap(docs, 1000, "d", "n")._jdf.queryExecution().executedPlan().toString()


def test_weights_are_poisson():
    w = metrics.poisson_weights(np.arange(2000, dtype=np.uint64) * np.uint64(977), 200)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08 and w.max() < 11
