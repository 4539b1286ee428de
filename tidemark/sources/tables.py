"""Reading and writing tables, whole texts and JSON lines."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "page_id string, source_id string, company string, website string, url string, html_path string, split string, capture_kind string, html_hash string, scraped_at string, is_article boolean"
ANNOTATION = "page_id string, html_hash string, labels map<string, int>, needs_review boolean, review_status string"
MODES = ("overwrite", "append", "errorifexists")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def read_or_empty(keys: DataFrame, texts: DataFrame, key: str = "path") -> DataFrame:
    """Every key with its text, '' where there is none."""
    return keys.join(texts, key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return checked(spark.read.schema(MANIFEST).json(path), {"page_id": F.col("page_id").isNotNull(), "html_hash": F.coalesce(F.col("html_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))})


def annotations(spark: SparkSession, path: str) -> DataFrame:
    return checked(spark.read.schema(ANNOTATION).json(path), {"page_id": F.col("page_id").isNotNull()})


def checked(rows: DataFrame, rules: dict) -> DataFrame:
    """Adds ``errors``: the names of the rules that a row breaks."""
    return rows.withColumn("errors", F.filter(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules.items())), lambda e: e.isNotNull()))


def write(rows: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """parquet, json, orc, csv or text (one string column)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    writer = rows.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(kind).save(path)


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; in local runs without it, as in tests, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/tidemark-{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """On whatever file system the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def small(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """A table to broadcast, if it has so many rows at most; else it is joined like any other. Counting stops at the bound."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
