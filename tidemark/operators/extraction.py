"""From pages to titles, bodies, dates and bylines: selection, rescue by rules, and documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.functions import text as T
from tidemark.operators import dom

#: A longer page is an error of its row, not of the job.
MAX_BYTES = 10_000_000
#: Score from which a field of the lenient form is accepted.
ACCEPT = 0.5
_FIELD = "struct<node_id: int, text: string, html: string, confidence: double>"


def title_variants(title: Column) -> Column:
    """A title, and its part before a spaced bar or dash if that has 20 characters at least."""
    head = F.regexp_extract(title, r"^(.{20,}?)\s+[|–—-]\s+", 1)
    return F.array_distinct(F.filter(F.array(title, F.when(head != "", head)), lambda t: t.isNotNull()))


def better_title(chosen: Column, others: Column, reference: Column, least: float = 0.9, gain: float = 0.18) -> Column:
    """The candidate most like the reference, if it is like enough and by so much better than what was chosen."""
    like = lambda t: T.token_f1(T.tokens(t), T.tokens(reference))
    scored = F.transform(others, lambda t: F.struct(like(t).alias("f"), (-F.length(t)).alias("o"), t.alias("t")))
    best = F.array_max(scored)
    return F.when((best["f"] >= least) & (best["f"] >= like(chosen) + gain), best["t"]).otherwise(chosen)


def tightest(nodes: DataFrame, wanted: Column, key: str = "page_id") -> DataFrame:
    """key, node_id of the shortest, deepest, earliest node that is wanted."""
    best = F.min(F.struct(F.length("text"), -F.col("depth"), F.col("node_id")))
    return nodes.where(F.col("kept") & wanted).groupBy(key).agg(best.alias("b")).select(key, F.col("b.node_id").alias("node_id"))


def rescue_byline(nodes: DataFrame, names: DataFrame, chosen: DataFrame, most: int = 250, key: str = "page_id") -> DataFrame:
    """key, node_id: the chosen byline if it has all of the metadata's names, else the tightest short node that has.

    ``names`` has the key and an array of names, ``chosen`` the key and node_id.
    """
    texts = nodes.join(names, key).where((F.size("names") > 0) & (F.length("text") <= most))
    covers = F.forall("names", lambda n: F.lower(F.col("text")).contains(F.lower(n)))
    found = tightest(texts, covers, key).withColumnRenamed("node_id", "found")
    good = texts.where(covers).select(key, "node_id", F.lit(True).alias("covers"))
    both = chosen.join(good, [key, "node_id"], "left").join(found, key, "left")
    return both.select(key, F.when(F.col("covers"), F.col("node_id")).otherwise(F.coalesce("found", "node_id")).alias("node_id"))


def pick_date(candidates: DataFrame, key: str = "page_id") -> DataFrame:
    """key, iso, node_id: the date that most candidates name, the earliest node of it; ``candidates`` has key, node_id, text."""
    dated = candidates.withColumn("iso", F.date_format(dates.calendar_date(F.col("text")), "yyyy-MM-dd")).where("iso is not null")
    groups = dated.groupBy(key, "iso").agg(F.count("*").alias("n"), F.min("node_id").alias("node_id"))
    return groups.groupBy(key).agg(F.max(F.struct("n", (-F.col("node_id")).alias("o"), "iso")).alias("b")).select(key, "b.iso", (-F.col("b.o")).alias("node_id"))


def selectors(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, node_id, selector: a path of tags with their places among equal siblings."""

    def work(html: str | None) -> list[dict]:
        nodes = dom.parse(html)
        seen: dict[tuple[int, str], int] = {}
        path: list[str] = [""] * len(nodes)
        for i, n in enumerate(nodes[1:], 1):
            seen[n.parent, n.tag] = k = seen.get((n.parent, n.tag), 0) + 1
            path[i] = f"{path[n.parent]} > {n.tag}:nth-of-type({k})" if n.parent else f"{n.tag}:nth-of-type({k})"
        return [{"node_id": n.number, "selector": p} for n, p in zip(nodes, path, strict=True) if n.number is not None]

    kind = pa.list_(pa.struct([("node_id", pa.int32()), ("selector", pa.string())]))
    return dom._per_page(pages, key, work, kind, "array<struct<node_id: int, selector: string>>", "s").select(key, F.explode("s").alias("s")).select(key, "s.*")


def extract(pages: DataFrame, scorer: dom.Scorer | None = None, missing: tuple[float, ...] = (0.0, 1.0, 0.5, 0.5), key: str = "page_id") -> DataFrame:
    """key, error, title, body, date, byline (node_id, text, html and confidence each) and published of every page.

    ``pages`` has the key, html and scraped_at (a timestamp). Without a trained scorer the weight-free scores choose. Each
    page is parsed once, with what it costs to choose all fields. A page that is too long has an error and no fields, and
    so has one that can't be read.
    """
    kind = pa.struct([("node_id", pa.int32()), ("text", pa.string()), ("html", pa.string()), ("confidence", pa.float64())])
    typed = pages.select(key, "scraped_at", F.col("html").cast("string").alias("html"))
    shared = typed.sparkSession.sparkContext.broadcast(scorer)  # a scorer's weights are some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in dom.slices(whole, 2)):
            errors, found = [], []
            for html in batch.column(2).to_pylist():
                error, fields = "too_large" if html is not None and len(html.encode("utf-8", "surrogatepass")) > MAX_BYTES else None, dict.fromkeys(dom.FIELDS)
                if error is None:
                    try:
                        fields = dom.selected(html, shared.value, missing)
                    except (AssertionError, ValueError, IndexError):  # the standard parser fails on some declarations
                        error = "unreadable"
                errors.append(error)
                found.append(fields)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(errors, pa.string()), *(pa.array([f[name] for f in found], kind) for name in dom.FIELDS)], [key, "scraped_at", "error", *dom.FIELDS])

    out = typed.mapInArrow(run, f"{key} {typed.schema[key].dataType.simpleString()}, scraped_at timestamp, error string, " + ", ".join(f"{f} {_FIELD}" for f in dom.FIELDS))
    # each found once, since what follows asks for it several times
    told = out.withColumn("_day", F.date_format(dates.calendar_date(F.col("date.text")), "yyyy-MM-dd")).withColumn("_ago", dates.relative_phrase(F.col("date.text")))
    return told.select(key, "error", *dom.FIELDS, dates.published(F.col("_day"), F.col("_ago"), F.col("scraped_at")).alias("published"))


def extract_all(pages: DataFrame, scorer: dom.Scorer | None = None, key: str = "page_id") -> DataFrame:
    """key, field, node_id, text, html, confidence: a row for each field that was found."""
    rows = extract(pages, scorer, key=key)
    each = F.array(*(F.struct(F.lit(f).alias("field"), *(F.col(f)[c].alias(c) for c in ("node_id", "text", "html", "confidence"))) for f in dom.FIELDS))
    return rows.select(key, F.explode(each).alias("x")).select(key, "x.*").where("node_id is not null")


def accepted(field: Column, least: float = ACCEPT) -> Column:
    return F.when(field["confidence"] >= least, field)


def boundary_report(rows: DataFrame, gold: str = "gold", before: str = "before", after: str = "after", near: Column | None = None) -> DataFrame:
    """n, changed, fixed, broken of a refinement of chosen nodes, and fixable: wrong ones whose right node is a candidate (``near``)."""
    near = F.lit(True) if near is None else near
    right = lambda c: F.col(c).eqNullSafe(F.col(gold))
    count = lambda c: F.sum(c.cast("int"))
    return rows.agg(F.count("*").alias("n"), count(~F.col(before).eqNullSafe(F.col(after))).alias("changed"), count(right(after) & ~right(before)).alias("fixed"), count(right(before) & ~right(after)).alias("broken"), count(~right(before) & F.col(gold).isNotNull() & near).alias("fixable"))


def folded_tokens(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the tokens of compatibility-normalised lower-case text."""
    import unicodedata

    word = re.compile(r"[^\W_]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in dom.slices(whole, whole.schema.get_field_index(column), rows=1024)):
            made = [word.findall(unicodedata.normalize("NFKC", t or "").casefold()) for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.string()))], [*batch.schema.names, out])

    from pyspark.sql import types

    return rows.mapInArrow(run, types.StructType([*rows.schema.fields, types.StructField(out, types.ArrayType(types.StringType()))]))


def rank_for_labels(nodes: DataFrame, score: Column, most: int = 128, budget: int = 75_000, key: str = "page_id") -> DataFrame:
    """A page's best candidates up to a number and a budget of characters."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "node_id")
    ranked = nodes.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.withColumn("used", F.sum(F.length("text")).over(w)).where(F.col("used") <= budget)


def local_candidates(nodes: DataFrame, seeds: DataFrame, up: int = 5, down: int = 7, most: int = 192, key: str = "page_id") -> DataFrame:
    """key, seed_id, node_id, distance: the seed, its kept ancestors and descendants within so many levels, nearest first.

    ``nodes`` has node_id, depth and subtree_end; a node is inside another if its number is in the other's range.
    """
    s = nodes.join(seeds.select(key, "node_id"), [key, "node_id"]).select(key, F.col("node_id").alias("seed_id"), F.col("subtree_end").alias("seed_end"), F.col("depth").alias("seed_depth"))
    both = nodes.where("kept").join(s, key)
    apart = F.col("depth") - F.col("seed_depth")
    above = (F.col("node_id") <= F.col("seed_id")) & (F.col("seed_id") < F.col("subtree_end")) & (apart >= -up)
    below = (F.col("seed_id") < F.col("node_id")) & (F.col("node_id") < F.col("seed_end")) & (apart <= down)
    near = both.where(above | below).select(key, "seed_id", "node_id", F.abs(apart).alias("distance"))
    w = Window.partitionBy(key, "seed_id").orderBy("distance", "node_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")


def refine_boundary(candidates: DataFrame, numbers: DataFrame, ranker: dom.Network, margin: float, key: str = "page_id") -> DataFrame:
    """key, seed_id, node_id: the candidate that the ranker puts highest if it is above the seed by the margin, else the seed.

    The ranker sees a node's numbers, those of the node less the seed's, and the distance; it gives one score.
    """
    rows = numbers.select(key, "node_id", "numbers")
    seed = rows.select(key, F.col("node_id").alias("seed_id"), F.col("numbers").alias("s"))
    pairs = candidates.join(rows, [key, "node_id"]).join(seed, [key, "seed_id"])
    apart = F.zip_with("numbers", "s", lambda a, b: a - b)
    made = pairs.select(key, "node_id", F.concat("numbers", apart, F.array(F.col("distance").cast("float"))).alias("numbers"), "seed_id")
    scored = dom.score_nodes(made.select(F.struct(key, "seed_id").alias("pair"), "node_id", "numbers"), ranker, "pair")
    flat = scored.select(F.col(f"pair.{key}").alias(key), "pair.seed_id", "node_id", F.get("scores", F.lit(0)).alias("score"))
    own = F.max(F.when(F.col("node_id") == F.col("seed_id"), F.col("score")))
    best = flat.groupBy(key, "seed_id").agg(F.max(F.struct("score", (-F.col("node_id")).alias("o"))).alias("b"), own.alias("own"))
    return best.select(key, "seed_id", F.when(F.col("b.score") > F.coalesce("own", F.lit(float("-inf"))) + margin, -F.col("b.o")).otherwise(F.col("seed_id")).cast("int").alias("node_id"))
