"""URL filters: rules first, then a path-template tree for each host.

A path's variable parts (runs of digits, long hexadecimal runs) become wildcards. The segments of what is left
make a tree below each host. Level by level, down to the deepest, branches with little support and branches whose
labels do not tell them from their siblings are merged into one wildcard branch. A template is rejected if the share of
good labels among its pages, smoothed towards that of the branch above and so on up to the share of all, is below a
threshold.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved

#: A branch's total is joined to its parts in so many parcels, so that one host's do not meet in one task.
PARCELS = 16
#: Pages that a branch needs to stand for itself.
SUPPORT = 20
#: Errors of difference between a branch's purity and its siblings' that keep them apart.
APART = 1.96
#: Pages' worth of the smoothing towards the level above.
SMOOTH = 5.0
PURITY = 0.5

#: (host, path, verdict); a rule covers its host's subdomains and the paths that start with its own.
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls without one. Rules are a short list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def pattern_of(path: Column) -> Column:
    """The path's segments with their variable parts as wildcards: ``~`` for long hexadecimal runs, ``#`` for digits. Such characters of the path itself are escaped."""
    escaped = F.replace(F.replace(path, F.lit("~"), F.lit("%7E")), F.lit("*"), F.lit("%2A"))
    general = F.regexp_replace(F.regexp_replace(escaped, r"(?i)(?<![0-9a-z%])(?=[0-9a-f-]*[0-9])[0-9a-f-]{12,}(?![0-9a-z])", "~"), r"(?<!%)(?<!%\d)\d+", "#")
    return F.filter(F.split(general, "/"), lambda x: x != "")


def templates(pages: DataFrame, good: Column) -> DataFrame:
    """host, pattern, template, n, good, bad, purity of each host's patterns.

    ``pages`` has columns host and path; ``good`` is 1 or 0 where a page has a label, else null.
    """
    rows = pages.select("host", pattern_of(F.col("path")).alias("pattern"), good.cast("int").alias("label"))
    leaves = rows.groupBy("host", "pattern").agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("good"), F.count("label").alias("known"))
    tree = grow(leaves)
    by_template = tree.groupBy("host", "at").agg(F.sum("n").alias("tn"), F.sum("good").alias("tg"), F.sum("known").alias("tk"))
    levels = F.transform(F.sequence(F.lit(1), F.size(F.split("at", "/"))), lambda i: F.array_join(F.slice(F.split("at", "/"), 1, i), "/"))
    above = by_template.select("host", "at", "tg", "tk", F.posexplode(levels).alias("level", "node"))
    nodes = above.groupBy("host", "node").agg(F.sum("tg").alias("ng"), F.sum("tk").alias("nk"))
    overall = by_template.agg(((F.coalesce(F.sum("tg"), F.lit(0)) + 1) / (F.coalesce(F.sum("tk"), F.lit(0)) + 2)).alias("top"))
    way = above.join(nodes, ["host", "node"]).groupBy("host", "at").agg(F.array_sort(F.collect_list(F.struct("level", "ng", "nk"))).alias("way"))
    purity = F.aggregate("way", F.col("top"), lambda p, x: (x["ng"] + SMOOTH * p) / (x["nk"] + SMOOTH))
    scored = by_template.join(way, ["host", "at"]).crossJoin(F.broadcast(overall)).select("host", "at", "tn", "tg", "tk", purity.alias("purity"))  # overall is one row
    return tree.select("host", "pattern", "at").join(scored, ["host", "at"]).select(
        "host", "pattern", F.col("at").alias("template"), F.col("tn").alias("n"), F.col("tg").alias("good"), (F.col("tk") - F.col("tg")).alias("bad"), "purity"
    )


def grow(leaves: DataFrame) -> DataFrame:
    """Adds ``at``, the template, to the patterns; ``leaves`` has host, pattern, n, good, known.

    A level is a join and a table that the next level reads, of those patterns only that go on. A branch with too little
    support, or with one pattern, has wildcards for all that follows, so that levels are as many as real branches have.
    """
    parts = []
    tree = saved(leaves.withColumn("at", F.lit("")))
    level = 0
    while True:
        step = F.when(F.size("pattern") > level, F.get("pattern", F.lit(level))).otherwise(F.lit(""))
        stepped = tree.withColumn("step", step)
        above = tree.groupBy("host", "at").agg(F.sum("n").alias("pn"), F.sum("good").alias("pg"), F.sum("known").alias("pk"), F.count("*").alias("patterns"))
        above = above.withColumn("parcel", F.explode(F.sequence(F.lit(0), F.lit(PARCELS - 1))))
        branch = stepped.groupBy("host", "at", "step").agg(F.sum("n").alias("bn"), F.sum("good").alias("bg"), F.sum("known").alias("bk"))
        judged = branch.withColumn("parcel", F.pmod(F.hash("step"), F.lit(PARCELS))).join(above, ["host", "at", "parcel"])
        share = (F.col("pg") + 1) / (F.col("pk") + 2)
        error = F.sqrt(share * (1 - share) / F.greatest(F.col("bk"), F.lit(1)))
        unlike = (F.col("bk") > 0) & (F.abs(F.col("bg") / F.greatest(F.col("bk"), F.lit(1)) - share) > APART * error)
        told = judged.select("host", "at", "step", ((F.col("bn") >= SUPPORT) & unlike).alias("own"), ((F.col("pn") < SUPPORT) | (F.col("patterns") == 1)).alias("closed"))
        ended = F.col("step") == ""
        rest = F.repeat(F.lit("/*"), F.size("pattern") - level)
        below = F.when(ended, F.col("at")).when(F.col("closed"), F.concat("at", rest)).otherwise(F.concat("at", F.lit("/"), F.when(F.col("own"), F.col("step")).otherwise("*")))
        moved = saved(stepped.join(told, ["host", "at", "step"]).select("host", "pattern", "n", "good", "known", below.alias("at"), (~ended & ~F.col("closed")).alias("goes_on")))
        parts.append(moved.where("NOT goes_on").drop("goes_on"))
        tree, level = moved.where("goes_on").drop("goes_on"), level + 1
        if tree.isEmpty():
            return functools.reduce(DataFrame.union, parts)


def judge(pages: DataFrame, rules: Sequence[Rule], good: Column, purity: float = PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row; ``pages`` has page_id, url and what ``good`` needs.

    Null urls and those without ``://`` have empty host and path; urls of any length and depth are judged whole. Without
    any label all templates have a purity of one half and are allowed; so is one whose purity is the threshold. Repeated
    rows are judged each; other columns are ignored, whatever their names; no rows give none.
    """
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), good.alias("good"))
    learned = templates(split, F.col("good")).select("host", "pattern", "template", "purity")
    rows = split.select("page_id", "host", "path", pattern_of(F.col("path")).alias("pattern"), name.alias("rule"), verdict.alias("given"))
    judged = rows.join(learned, ["host", "pattern"], "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("purity") < purity, "block").otherwise("allow")).alias("verdict"), "template", "purity")
