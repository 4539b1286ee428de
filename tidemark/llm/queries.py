"""The queries that apply the operators to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, html_text, language, merkle, mixing, quality, simhash, suffix, toxicity, urls
from tidemark.llm.common import fold, saved, table

Query = Callable[[SparkSession, str], DataFrame]


def held_out(folds: int, fold_: int) -> Column:
    """Whether a document's fold is left out of learning; a null id is in no fold and never learned from."""
    return F.coalesce(fold(F.col("doc_id"), folds) == fold_, F.lit(True))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = saved(quality.features(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(5, 0))
    return quality.score(seen, quality.fit(seen, labels))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(5, 0))
    scored = toxicity.score(docs, toxicity.fit(docs, labels), held_out(5, 0).alias("held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), F.col("page_id"), F.col("url"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs, language.fit(docs.where(~held_out(4, 2))), held_out(4, 2).alias("held_out"))


#: Host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's url names its document by number; the document's quality is the page's label."""
    number = F.try_to_number(F.regexp_extract("url", r"/(\d{1,18})(?:[./?#]|$)", 1), F.lit("9" * 18)).cast("long")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", number.alias("number"))
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("number")).agg(F.max("quality").alias("quality"))
    return urls.judge(pages.join(labels, "number", "left"), URL_RULES, F.col("quality"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.neighbours(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_html": op4_html,
    "op5_mixing": op5_mixing,
    "op6_suffix": op6_suffix,
    "op7_language": op7_language,
    "op8_urls": op8_urls,
    "op9_simhash": op9_simhash,
    "op10_merkle": op10_merkle,
}
