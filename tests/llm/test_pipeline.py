import random

import corpus_pipeline
import pytest
from slotforge.llm import pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_stages_keep_the_columns_and_drop_rows_only(stages):
    for before, after in zip(stages, stages[1:-1], strict=False):
        assert after.columns == before.columns and after.dtypes == before.dtypes
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}


def test_stages_do_their_work(stages):
    raw, language, unique, clean, redacted, packed = stages
    assert language.count() >= 0.99 * raw.count()
    texts = [r.text for r in unique.collect()]
    assert len(texts) == len(set(texts)) < language.count()
    assert clean.count() < unique.count()
    rows = redacted.collect()
    assert len(rows) == clean.count() and all(pii.find(r.text) == ([], []) and r.n_chars == len(r.text) for r in rows)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in rows}


def test_run_is_the_stages_in_order(spark, stages):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(columns).collect())) == sorted(map(tuple, stages[-1].select(columns).collect()))


def test_nulls_and_odd_rows(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(["the", "and", "of", "that", "with", "is"]) for _ in range(30)), "en", "s", 1) for i in range(20)]
    rows += [(50, None, None, None, None), (51, "12 34", None, None, None), (None, "the and of with that", None, None, None), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    ids = {r.doc_id for r in docs.collect()}
    assert None in ids and not {50, 51} & ids
    empty = docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
