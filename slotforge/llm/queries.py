"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slotforge.llm import chat, collocation, decontam, langid, neardup, packing, pii, quality, repair, sharding, substring, vptree, warc
from slotforge.llm.sql import ORACLE_SQL  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), ranks_path=path("byte_bpe_50k.tiktoken"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), sharding.tree(16), sharding.tree(17))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    archives = warc.write(pages, warc.new_folder(spark))
    return warc.lookup(archives, pages, id_column="page_id").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs.where(~langid.is_held_out(docs["doc_id"]))))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(_table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return chat.digest(_table(spark, sf_dir, "conversations"), path("byte_bpe_50k.json"), ranks_path=path("byte_bpe_50k.tiktoken"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.mine(_table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.components(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(repair.repair(repair.damage(_table(spark, sf_dir, "conversations"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_pii, op3_sharding, op4_substring_dedup, op5_warc, op6_decontamination, op7_quality, op8_language,
        op9_near_duplicates, op10_chat, op11_collocations, op12_simhash, op13_conversation_repair,
    )
}
