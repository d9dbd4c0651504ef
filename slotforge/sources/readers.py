"""Sources and sinks (ids S1-S15 of the survey). A bad row is reported, never an exception in a task."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotforge.functions import values as V

OCR = (
    "doc_id STRING, pages ARRAY<STRUCT<page_idx INT, blocks ARRAY<STRUCT<lines ARRAY<STRUCT<words ARRAY<STRUCT<value STRING, confidence DOUBLE, geometry ARRAY<ARRAY<DOUBLE>>>>>>>>>>"
)
RESPONSE = "doc_id STRING, mode STRING, http_status INT, data MAP<STRING, STRING>, _corrupt STRING"
LEDGER = (
    "seq BIGINT, decision_id STRING, snapshot STRING, target_id STRING, doc_id STRING, field STRING, decision STRING, corrected_value STRING, claim_id STRING, "
    "rationale STRING, adjudicator STRING, decided_at TIMESTAMP, supersedes STRING"
)


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OCR).json(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Stored responses; ``usable`` only with status 200, whole JSON and data. Others stay as rows without data."""
    rows = spark.read.schema(RESPONSE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    usable = (F.col("http_status") == 200) & F.col("_corrupt").isNull() & F.col("data").isNotNull()
    return rows.select("doc_id", "mode", "http_status", F.coalesce(usable, F.lit(False)).alias("usable"), F.when(usable, F.col("data")).alias("data"))


def stored_documents(responses: DataFrame, mode: str) -> DataFrame:
    return responses.where((F.col("mode") == mode) & F.col("usable")).select("doc_id").distinct()


def response_drafts(responses: DataFrame) -> DataFrame:
    """(doc_id, field, value, drafted_by) of each value that a usable response claims; unknown fields stay, to be refused."""
    rows = responses.where("usable").select("doc_id", F.explode("data").alias("field", "value"), F.concat(F.lit("mode:"), F.col("mode")).alias("drafted_by"))
    return rows.withColumn("value", V.blank_to_null(F.col("value"))).where("value IS NOT NULL")


def parse_readings(lines: DataFrame, reader: Column) -> tuple[DataFrame, DataFrame]:
    """(readings, malformed) of tab-separated lines: doc, field, value, label, note; short rows and unknown fields are set
    aside with the reader, and the last line of a key wins. ``lines`` has ``value`` and ``ord``."""
    cells = F.split("value", "\t")
    rows = lines.select("ord", "value", reader.alias("reader"), cells.alias("c"))
    good = (F.size("c") >= 3) & F.get("c", F.lit(1)).isin(*V.NAMES)
    cell = lambda i: F.get("c", F.lit(i))
    kept = rows.where(good).select("reader", "ord", cell(0).alias("doc_id"), cell(1).alias("field"), V.blank_to_null(cell(2)).alias("value"), F.coalesce(V.blank_to_null(cell(3)), F.lit("NONE")).alias("label"))
    last = kept.groupBy("reader", "doc_id", "field").agg(F.max_by(F.struct("value", "label"), "ord").alias("r"))
    return last.select("reader", "doc_id", "field", "r.value", "r.label"), rows.where(~good).select("reader", "ord", "value")


def read_readings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Every reader's file; the reader is the part of the file name before ``.tsv`` and after the last dot."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ord"), F.col("_metadata.file_name").alias("file"))
    return parse_readings(lines, F.regexp_extract("file", r"([^.]+)\.tsv$", 1))


def answers(model_text: DataFrame, fields: DataFrame) -> DataFrame:
    """All fields of each document from a model's lines ``field<TAB>value``; unanswered ones are null."""
    rows = model_text.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")).select("doc_id", "ord", F.split("line", "\t").alias("c"))
    known = rows.where(F.size("c") >= 2).select("doc_id", F.get("c", F.lit(0)).alias("field"), V.blank_to_null(F.get("c", F.lit(1))).alias("value"), "ord")
    last = known.groupBy("doc_id", "field").agg(F.max_by("value", "ord").alias("value"))
    grid = model_text.select("doc_id").distinct().crossJoin(F.broadcast(fields.select("field")))  # ten rows
    return grid.join(last, ["doc_id", "field"], "left")


def truth(annotations: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(truth, truth_docs): the first non-empty text of each mapped field; every document with a record."""
    rows = annotations.select("doc_id", F.posexplode("field_extractions").alias("ord", "x")).select("doc_id", "ord", "x.fieldtype", V.blank_to_null(F.col("x.text")).alias("text"))
    named = rows.where("text IS NOT NULL").join(F.broadcast(mapping), "fieldtype")
    return named.groupBy("doc_id", "field").agg(F.min_by("text", "ord").alias("text")), annotations.select("doc_id").distinct()


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(path)


def register_artifacts(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, present, sha256) of each expected file; ``files`` is a binaryFile read with its path column."""
    found = files.select("path", F.sha2("content", 256).alias("sha256"))
    return expected.join(found, "path", "left").select("path", F.col("sha256").isNotNull().alias("present"), "sha256")


def discover(paths: DataFrame, suffixes: tuple[str, ...] = ("pdf", "png", "jpg")) -> DataFrame:
    """(path, doc_id): a slug of the file's stem, a digest where that is empty, a number where it is taken."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = paths.where(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*suffixes))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    rows = rows.withColumn("slug", F.when(slug == "", F.concat(F.lit("doc-"), F.substring(F.sha2("path", 256), 1, 8))).otherwise(slug))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("path"))
    return rows.withColumn("n", n).select("path", F.when(F.col("n") > 1, F.concat("slug", F.lit("-"), F.col("n").cast("string"))).otherwise(F.col("slug")).alias("doc_id"))


def inject(rows: DataFrame, existing: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """(new suggestions, dropped with reason): known field, a value, and not yet answered under the tag."""
    reason = F.when(~F.col("field").isin(*V.NAMES) | F.col("field").isNull(), "unknown_field").when(V.blank_to_null(F.col("value")).isNull(), "no_value").when(F.col("doc_id").isNull(), "no_document")
    judged = rows.withColumn("reason", reason)
    fresh = judged.where("reason IS NULL").drop("reason").dropDuplicates(["doc_id", "field"])
    had = existing.where(F.col("tag") == tag).select("doc_id", "field").distinct()
    return fresh.join(had, ["doc_id", "field"], "left_anti").withColumn("tag", F.lit(tag)), judged.where("reason IS NOT NULL")


def queue_suggestions(readings: DataFrame, queue: DataFrame) -> DataFrame:
    """Readings of slots in the queue; abstentions become blanks, a missing label NONE."""
    value = F.coalesce(V.blank_to_null(F.col("value")), F.lit(""))
    return readings.join(queue.select("doc_id", "field").distinct(), ["doc_id", "field"], "left_semi").withColumn("value", value)


def role_suggestions(readings: DataFrame) -> DataFrame:
    """(doc_id, field, value) of a reading's parties, the first role that is filled."""
    first = lambda *names: F.coalesce(*[V.blank_to_null(F.col(n)) for n in names])
    rows = F.array(F.struct(F.lit("seller_name").alias("field"), first("seller", "station").alias("value")), F.struct(F.lit("buyer_name").alias("field"), first("buyer", "agency", "advertiser").alias("value")))
    return readings.select("doc_id", F.inline(rows)).where("value IS NOT NULL")


class AlreadyWritten(Exception):
    """Another writer's table stands at the path, or is being put there."""

    def __init__(self, path: str):
        super().__init__(f"[PATH_ALREADY_EXISTS] {path}")


def _store(spark: SparkSession, path: str):
    """(file system, a function that makes its paths) of a path of any store that Spark can write to."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), to_path


def write_once(frame: DataFrame, path: str, *partition_by: str) -> None:
    """One artifact as Parquet, whole or not at all; a second writer is refused (``AlreadyWritten``), also at the same time.

    The table is written beside the path; then a marker is created that names it, which the store lets only one writer
    do, and the table is renamed to the path. A driver that is lost before the marker leaves nothing but a staged folder;
    one lost after it leaves a whole table, which ``read_once`` puts in place.
    """
    spark, path = frame.sparkSession, path.rstrip("/")
    fs, to_path = _store(spark, path)
    if fs.exists(to_path(path)) or fs.exists(to_path(_marker(path))):
        raise AlreadyWritten(path)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    writer = frame.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged)
    try:
        out = fs.create(to_path(_marker(path)), False)
    except Py4JJavaError as e:
        fs.delete(to_path(staged), True)
        raise AlreadyWritten(path) from e
    out.write(bytearray(staged.rsplit("/", 1)[1].encode()))
    out.close()
    _finish(fs, to_path, path, staged)


def _marker(path: str) -> str:
    return f"{path}.committed"


def _finish(fs, to_path, path: str, staged: str) -> None:
    if not fs.exists(to_path(path)) and not fs.rename(to_path(staged), to_path(path)) and not fs.exists(to_path(path)):
        raise OSError(f"{staged} could not be put at {path}")


def read_once(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``write_once`` committed; one whose writer was lost after the commit is put in place first."""
    path = path.rstrip("/")
    fs, to_path = _store(spark, path)
    if not fs.exists(to_path(path)) and fs.exists(to_path(_marker(path))):
        name = spark.read.text(_marker(path)).first()[0]  # one line
        _finish(fs, to_path, path, f"{path.rsplit('/', 1)[0]}/{name}")
    return spark.read.parquet(path)
