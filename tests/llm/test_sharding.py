import zlib

from pyspark.sql import functions as F
from slotforge.llm import sharding


def test_sizes_slots_and_growth(docs, corpus):
    rows = sharding.assign(docs, sharding.tree(16), sharding.tree(17), buckets=8).collect()
    assert len(rows) == len(corpus)
    want = sorted((str(c[0]), len((c[1] or "").encode()) + 1, zlib.crc32((c[1] or "").encode())) for c in corpus)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    for s in range(16):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and {r.law for r in rows} == {"key"}
    by_key = {}
    assert all(by_key.setdefault(r.doc_id, r.shard) == r.shard for r in rows)


def test_growth_moves_rows_into_the_new_shard_only_at_every_count(spark):
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    trees = {f"t{n}": sharding.tree(n) for n in (7, 8, 9, 16, 17, 18)}
    rows = sharding.with_shard(ids, F.col("doc_id").cast("string"), trees).collect()
    for a, b in ((7, 8), (8, 9), (16, 17), (17, 18)):
        assert all(r[f"t{b}"] in (r[f"t{a}"], b - 1) for r in rows)
    counts = [sum(r.t16 == s for r in rows) for s in range(16)]
    assert min(counts) > 110 and max(counts) < 270


def test_weights_draw_in_proportion_and_confine_movement(spark):
    ids = spark.range(8000).withColumnRenamed("id", "doc_id")
    old = [sharding.Leaf("a", "r1", 0, 1), sharding.Leaf("a", "r1", 1, 2), sharding.Leaf("a", "r2", 2, 1), sharding.Leaf("b", "r3", 3, 4)]
    new = [*old[:1], sharding.Leaf("a", "r1", 1, 3), *old[2:]]
    rows = sharding.with_shard(ids, F.col("doc_id").cast("string"), {"old": old, "new": new}).collect()
    share = [sum(r.old == s for r in rows) / 8000 for s in range(4)]
    assert all(abs(a - b) < 0.03 for a, b in zip(share, [1 / 8, 2 / 8, 1 / 8, 4 / 8], strict=True))
    assert all(r.new in (r.old, 1) for r in rows) and any(r.new != r.old for r in rows)


def test_empty_table(nothing):
    assert sharding.assign(nothing, sharding.tree(16), sharding.tree(17)).count() == 0


def test_a_hot_id_with_many_texts_and_clashing_columns(spark):
    rows = [(7, f"text {i}", 1, 2, 3, 4) for i in range(400)] + [(None, "n", 1, 2, 3, 4)] * 5 + [(i, "same", 1, 2, 3, 4) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, bucket int, rank int, first int").repartition(4)
    found = sharding.assign(df, sharding.tree(16), sharding.tree(17)).collect()
    for s in range(16):
        own = sorted(r.slot for r in found if r.shard == s)
        assert own == list(range(len(own)))
    assert len(found) == len(rows) and len({r.shard for r in found if r.doc_id == 7}) == 1
