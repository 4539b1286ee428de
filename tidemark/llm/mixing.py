"""Mix sources to target weights.

Every document gets a random key that depends on its id only. Within a source documents are taken in the
order of their keys; prefix sums of their sizes tell where the source's budget ends. Leading digits of the key cut a
source's range into buckets of bounded size whose sums are combined before the shuffle. The bucket in which a budget
ends is found by prefix sums over a few digits at a time, from the first ones on: no task ever sums over all buckets
of a source. Only that one bucket's documents are sorted; all others are before or behind the cut and stay where they
are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, drop_saved, saved

#: Rows that a bucket of one source holds on average, at most.
BUCKET_ROWS = 500
#: Digits of the key, which are hexadecimal, that buckets go by at most, and that one round of prefix sums goes by.
MAX_DIGITS, STEP = 12, 3


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column, seed: str) -> Column:
    """By the id; documents without one have keys by their texts, so that they don't share one."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string")))
    return F.md5(F.concat(name, F.lit(":" + seed)).cast("binary"))


def targets(sizes: dict[str | None, int], weights: Sequence[float], share: float, repeats: float) -> dict[str | None, float]:
    """Words wanted of each source.

    Sources by code point, null last, have the ``weights``, repeating. Together they get ``share`` of all
    words; none gets more than ``repeats`` times its own, and what it can't take goes to the others by weight.
    """
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, open_ = share * sum(sizes.values()), set(order)
    out: dict[str | None, float] = {}
    while open_:
        unit = (total - sum(out.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > repeats * sizes[s]}
        out |= {s: float(repeats * sizes[s]) for s in full} if full else {s: max(0.0, unit * weight[s]) for s in open_}
        open_ -= full or open_
    return out


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    repeats: float = 2.0,
    seed: str = "mix",
    bucket_rows: int = BUCKET_ROWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: the columns to keep, doc_id, source, size, source_size, target, taken.

    ``taken`` is how many words of the document the mix takes over all epochs. A source's taken words add up to its
    target, rounded down.

    The number of sources is taken to be small (each is a row on the driver); they get their weights in order, one by
    one. Null or empty texts have size 0 and nothing is taken; texts of any length count whole; a null source is a
    source of its own; rows with the same id share a key and are ordered by size, further ties count as given; a table
    without rows gives none. Columns that are not to be kept are ignored, whatever their names; those to keep must not
    have a name of the result's.
    """
    size, key = size_of(F.col("text")), random_key(F.col("doc_id"), F.col("text"), seed)
    plain = docs.select("doc_id", "source", size.alias("size"), key.alias("key"))
    # without more columns a few numbers a document are written once, instead of reading texts twice
    rows = docs.select(*keep, *(c for c in ("doc_id", "source") if c not in keep), size.alias("size"), key.alias("key")) if keep else saved(plain)
    numbers = plain if keep else rows
    most = docs.count()
    digits = next(d for d in range(MAX_DIGITS + 1) if most <= bucket_rows * 16**d or d == MAX_DIGITS)
    bucket = F.substring("key", 1, digits) if digits else F.lit("")
    sums = saved(numbers.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size")))
    facts = cuts(sums, weights, share, repeats, digits)
    drop_saved(sums)

    # a row for each source, as on the driver
    placed = rows.withColumn("bucket", bucket).join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("s")))
    named = [*keep, *(c for c in ("doc_id", "source") if c not in keep), "size", "source_size", "target"]
    whole = F.col("epochs") * F.col("size")
    at_cut = F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
    clear = placed.where(~at_cut).select(*named, (whole + F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(0)).cast("long").alias("taken"))
    ahead = Window.partitionBy("s").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("ahead") + F.coalesce(F.sum("size").over(ahead), F.lit(0))
    last = F.greatest(F.lit(0), F.least("size", F.col("rest") - before))
    return clear.union(placed.where(at_cut).select(*named, (whole + last).cast("long").alias("taken")))


def cuts(sums: DataFrame, weights: Sequence[float], share: float, repeats: float, digits: int) -> DataFrame:
    """s, source_size, target, epochs, rest, cut, ahead of each source.

    It is taken ``epochs`` times as a whole and once up to ``rest`` words: the buckets before ``cut``, with ``ahead``
    words, and the first ones of that bucket. Without a rest there is no cut.
    """
    spark = sums.sparkSession
    sizes = {r["source"]: int(r["size"]) for r in sums.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    wanted = targets(sizes, weights, share, repeats)
    epochs = {s: int(wanted[s]) // n if n else 0 for s, n in sizes.items()}
    rest = {s: int(wanted[s]) - epochs[s] * n for s, n in sizes.items()}
    open_ = {s: ("", 0) for s, left in rest.items() if left > 0}  # prefix of the cut, words before it
    for length in [*range(STEP, digits, STEP), digits] if digits and open_ else []:
        known = spark.createDataFrame([(s, p, ahead, rest[s]) for s, (p, ahead) in open_.items()], "s string, prefix string, ahead long, rest long")
        inside = sums.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("s")) & F.col("bucket").startswith(F.col("prefix")))
        parts = inside.groupBy("s", F.substring("bucket", 1, length).alias("part")).agg(F.sum("size").alias("n"), F.first("ahead").alias("ahead"), F.first("rest").alias("rest"))
        up_to = F.col("ahead") + F.sum("n").over(Window.partitionBy("s").orderBy("part"))  # 16 ** STEP parts of a source at most
        hit = parts.withColumn("up_to", up_to).where("up_to - n < rest AND rest <= up_to")
        open_ = {r["s"]: (r["part"], int(r["up_to"] - r["n"])) for r in hit.collect()}
    facts = [(s, n, wanted[s], epochs[s], rest[s], *open_.get(s, (None, 0))) for s, n in sizes.items()]
    return spark.createDataFrame(facts, "s string, source_size long, target double, epochs long, rest long, cut string, ahead long")
