"""A training corpus out of raw documents, stage by stage.

Stages take and give rows, not ids: ids may be null or repeat, repeated rows are rows of their own, and a row's decision
never touches another with its id. Null and empty texts have no language and go in the first stage; texts of any length
are taken whole; extra columns are dropped; a table without rows goes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, mixing, simhash, suffix
from tidemark.llm.common import saved, table
from tidemark.llm.queries import held_out

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go, and those whose best language hasn't half of the posterior."""
    model = language.fit(docs.where(~held_out(4, 2)))
    kept = [F.col(c) for c in COLUMNS if c not in ("doc_id", "text")]
    found = language.identify(docs, model, F.col("text").alias("whole"), *kept)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= 0.5)).select("doc_id", F.col("whole").alias("text"), "lang", "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the smallest id, null last; of equal ones any."""
    return simhash.near_copies(docs, keep=("text", "lang", "source", "n_chars")).where("original").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; documents of which nothing is left go."""
    cut = suffix.repeats(docs, keep=("lang", "source")).where("trim(text) != ''")
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go; those without a text hold none."""
    kept = [F.col(c) for c in COLUMNS if c != "text"]
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"), *kept).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of words taken over all epochs."""
    return mixing.mix(docs, keep=COLUMNS).where("taken > 0").select(*COLUMNS, "size", "taken")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix_sources),
]
#: Models and hashes that SQL hasn't; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
