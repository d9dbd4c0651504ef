"""Columns whose names clash with those of operators and stages, and ties, for operators whose own tests lack them."""

import corpus_pipeline
import public_tokenizers as P
import pytest
from slotforge.llm import langid, neardup, packing, warc

JSON = P.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
#: Names that the operators give to columns of their own.
CLASHING = "ids string, sequence_id int, `offset` long, bands string, band int, hub long, component long, sets int, slot int, key long, at long, stretch string, `__gone` long, `__again` int, letter string, score double"


def clashing(spark, rows):
    extra = ("x", 1, 2, "b", 3, 4, 5, 6, 7, 8, 9, "s", 10, 11, "l", 0.5)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


ROWS = [(i, " ".join(["the", "and", "of", "that", "with", "is"][(i * k) % 6] for k in range(1, 40)) + f" w{i}", "en", "s", 1) for i in range(12)]


def plain(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("operator", [
    lambda docs: packing.pack(docs, JSON).select("doc_id", "start", "length", "ids_crc32"), lambda docs: neardup.components(docs), lambda docs: langid.predict(docs, langid.train(docs)).select("doc_id", "held_out", "lang_pred", "score"),
], ids=["packing", "near_duplicates", "language"])
def test_operators_read_their_own_columns(spark, operator):
    rows = [*ROWS, ROWS[0], (None, None, None, None, None)]
    assert sorted(map(str, operator(clashing(spark, rows)).collect())) == sorted(map(str, operator(plain(spark, rows)).collect()))


def test_archives_of_clashing_columns(spark):
    pages = [(i, f"http://h{i % 2}.org/p", f"<p>{i % 3}</p>") for i in range(6)]
    named = spark.createDataFrame([(*p, "k", 1, b"x") for p in pages], "page_id long, url string, html string, key string, block int, payload binary")
    found = [warc.lookup(warc.write(t, warc.new_folder(spark)), t, id_column="page_id").select("page_id", "payload_digest", "record_type", "refers_to").collect() for t in (named, named.select("page_id", "url", "html"))]
    assert sorted(map(str, found[0])) == sorted(map(str, found[1]))
    # of equal payloads the largest page is the response, also at one url
    assert {r.page_id: r.refers_to for r in found[0]} == {0: 3, 1: 4, 2: 5, 3: None, 4: None, 5: None}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_clashing_columns(spark, name, stage):
    docs = clashing(spark, [*ROWS, (90, ROWS[3][1], "en", "s", 1)])
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    kept = out.collect()
    assert len(kept) == (12 if name == "near_dedup" else 13) and {(r.ids, r.component, r["__gone"], r.score) for r in kept} == {("x", 5, 10, 0.5)}


def test_the_last_stage_reads_its_own_columns(spark):
    name, stage = corpus_pipeline.STAGES[-1]
    columns = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(str, stage(spark, clashing(spark, ROWS), SF).select(columns).collect())) == sorted(map(str, stage(spark, plain(spark, ROWS), SF).select(columns).collect()))


def test_ties_between_languages_and_long_texts(spark):
    """Two languages with the same texts: both fit alike, one of them is named, and the same one for equal texts."""
    rows = [(i, "same words here", ("aa", "bb")[i % 2], "s", 1) for i in range(20)]
    found = langid.predict(plain(spark, [*rows, (50, "same words here " * 20_000, None, "s", 1)]), langid.train(plain(spark, rows))).collect()
    assert len(found) == 21 and {r.lang_pred for r in found} <= {"aa", "bb"} and len({r.lang_pred for r in found if r.doc_id < 50}) == 1
    assert all(0 <= r.score <= 1 for r in found)
