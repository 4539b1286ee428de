"""Data sets for models: splits, samples, vocabularies, normalisers, joins that check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequence_ids(rows: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """Adds sequence_id: 1, 2, ... in the order of the keys' SHA-256, the same whoever counts; keys are unique.

    Leading digits of the digest cut the order into 16 ** digits parts, which are numbered apart; only the parts' sizes
    meet in one task.
    """
    hashed = rows.withColumn("_digest", F.sha2(F.col(key).cast("string"), 256)).withColumn("_part", F.substring("_digest", 1, digits))
    sizes = hashed.groupBy("_part").agg(F.count("*").alias("_n"))  # 16 ** digits rows at most
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", ahead.alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_digest"))
    return hashed.join(F.broadcast(starts), "_part").withColumn("sequence_id", F.col("_ahead") + place).drop("_digest", "_part", "_ahead")


def split_sites(pages: DataFrame, site: str, test: float = 0.15, validation: float = 0.15) -> DataFrame:
    """site, split: sites in the order of their SHA-256, the first part test, the next validation.

    Sizes are rounded half to even.
    """
    ranked = sequence_ids(pages.select(site).distinct(), site)
    n = pages.agg(F.count_distinct(site).alias("n"))
    k, m = (F.greatest(F.lit(1), F.bround(F.col("n") * x).cast("int")) for x in (test, validation))
    rank = F.col("sequence_id")
    return ranked.crossJoin(F.broadcast(n)).select(site, F.when(rank <= k, "test").when(rank <= k + m, "validation").otherwise("train").alias("split"))  # n is one row


def round_robin(rows: DataFrame, group: str, order: str, ranks: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` rows when groups take turns, in the order of ``ranks``."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    place = F.array_position(F.array(*(F.lit(r) for r in ranks)), F.col(group))
    return rows.where(F.col(group).isin(*ranks)).withColumn("turn", turn).where(F.col("turn") <= most).orderBy("turn", place).limit(most)


def one_per_group_first(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """One row of each group, then the others, up to ``most``."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("later", (turn > 1).cast("int")).orderBy("later", order).limit(most)


def vocabulary(tokens: DataFrame, token: str, priority: Sequence[str] = (), size: int = 64) -> DataFrame:
    """token, id, n: priority tokens, then the most frequent (ties by token), numbered from 2; 0 is padding, 1 unknown."""
    listed = F.array_position(F.array(*(F.lit(p) for p in priority)) if priority else F.array().cast("array<string>"), F.col("token"))
    counts = tokens.groupBy(F.col(token).alias("token")).agg(F.count("*").alias("n")).withColumn("listed", listed)
    kept = counts.orderBy((F.col("listed") == 0).cast("int"), "listed", F.desc("n"), "token").limit(size)
    order = Window.orderBy((F.col("listed") == 0).cast("int"), "listed", F.desc("n"), "token")
    return kept.select("token", (F.row_number().over(order) + 1).alias("id"), "n")


def tag_vocabulary(nodes: DataFrame, tag: str = "tag", parent: str = "parent_tag") -> DataFrame:
    """tag, id: the distinct tags of elements and their parents, sorted and numbered from 2; 0 is padding, 1 unknown. Tags are few."""
    found = nodes.select(F.lower(F.col(tag)).alias("tag")).union(nodes.select(F.lower(F.col(parent)))).where("tag is not null").distinct()
    return found.agg(F.array_sort(F.collect_list("tag")).alias("tags")).select(F.posexplode("tags").alias("id", "tag")).select("tag", (F.col("id") + 2).alias("id"))


def normalizer(rows: DataFrame, columns: Sequence[str], least: float = 1e-6) -> DataFrame:
    """column, mean, std: population deviation, 1 where it is next to nothing."""
    stats = rows.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean"), F.when(F.col(f"s_{c}") < least, 1.0).otherwise(F.col(f"s_{c}")).alias("std")) for c in columns))
    return stats.select(F.explode(cells).alias("c")).select("c.column", "c.mean", "c.std")


def joined(manifest: DataFrame, annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """Manifest, annotation and page by page_id; a hash that is stale in any of them fails the job."""
    rows = manifest.join(annotations.withColumnRenamed("html_hash", "annotated_hash"), "page_id").join(pages.select("page_id", "html"), "page_id")
    stale = (F.col("html_hash") != F.col("annotated_hash")) | (F.col("html_hash") != F.sha2("html", 256))
    return rows.where(F.when(stale, F.raise_error(F.concat(F.lit("stale "), F.col("page_id"))).cast("boolean")).otherwise(True)).drop("annotated_hash")


def stale(overrides: DataFrame, rows: DataFrame, key: str, digest: str = "html_hash") -> DataFrame:
    """Overrides whose row has another digest by now."""
    now = rows.select(key, F.col(digest).alias("_now"))
    return overrides.join(now, key).where(~F.col(digest).eqNullSafe(F.col("_now"))).drop("_now")


def unused(overrides: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return overrides.join(rows.select(key).distinct(), key, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def upsert(old: DataFrame, new: DataFrame, key: str, keep: Sequence[str], overwrite: Sequence[str]) -> DataFrame:
    """New rows over old ones: ``keep`` columns stay where the new value is empty, ``overwrite`` columns take it anyway."""
    o, n = old.select(key, *(F.col(c).alias(f"o_{c}") for c in (*keep, *overwrite))), new.select(key, F.lit(True).alias("is_new"), *(F.col(c).alias(f"n_{c}") for c in (*keep, *overwrite)))
    both = o.join(n, key, "full")
    kept = [F.coalesce(F.nullif(F.col(f"n_{c}"), F.lit("")), F.col(f"o_{c}")).alias(c) for c in keep]
    return both.select(key, *kept, *(F.when(F.col("is_new"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in overwrite))


def nearest_anchor(rows: DataFrame, by: str, at: str, is_anchor: str) -> DataFrame:
    """Adds anchor: the position of the nearest row that is one, the earlier of two as near."""
    w = Window.partitionBy(by).orderBy(at)
    here = F.when(F.col(is_anchor), F.col(at))
    before = F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("_b", before).withColumn("_a", after).withColumn("anchor", F.when(F.col("_a").isNull() | (F.col(at) - F.col("_b") <= F.col("_a") - F.col(at)), F.col("_b")).otherwise(F.col("_a"))).drop("_b", "_a")


def encode(tokens: Column, ids: dict[str, int], size: int) -> Column:
    """The first ``size`` tokens as ids: 1 for an unknown one, filled up with 0. ``ids`` is a vocabulary, so it is small."""
    known = F.create_map(*(F.lit(x) for kv in ids.items() for x in kv)) if ids else F.create_map().cast("map<string, int>")
    numbers = F.transform(F.slice(tokens, 1, size), lambda t: F.coalesce(known[t], F.lit(1)))
    return F.concat(numbers, F.array_repeat(F.lit(0), F.lit(size) - F.size(numbers)))


def standardize(value: Column, mean: float, std: float, clip: float | None = None) -> Column:
    scaled = (value - mean) / std
    return scaled if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), scaled))
