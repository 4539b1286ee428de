"""Crawl frontier: URL kinds, seen URLs, links, sitemaps, robots rules, politeness."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.sources.tables import small

#: Seconds between requests where robots.txt asks for none.
DEFAULT_DELAY = 5.0
MAX_DEPTH = 3
CATALOG = "id string, company string, host string, listing_paths array<string>, article_path_patterns array<string>, follow_path_patterns array<string>, sitemap_paths array<string>"


def classify(pages: DataFrame, catalog: DataFrame, url: str = "url") -> DataFrame:
    """Adds kind and source_id: sitemap, listing, article or reject.

    A host's sources are asked in the order of their ids: listing paths, then patterns that are followed as
    listings, then articles; a path that looks like a sitemap is one on hosts with sitemaps. The catalog is a
    small dimension, cut to a row for each host and rule before the join.
    """
    p = F.regexp_replace(F.col("p"), "/+$", "")
    rules = catalog.select(
        "host",
        "id",
        F.explode(
            F.concat(
                F.transform(F.coalesce("listing_paths", F.array()), lambda x: F.struct(F.lit(0).alias("rank"), F.regexp_replace(x, "/+$", "").alias("rule"), F.lit("listing").alias("kind"))),
                F.transform(F.coalesce("follow_path_patterns", F.array()), lambda x: F.struct(F.lit(1).alias("rank"), x.alias("rule"), F.lit("listing").alias("kind"))),
                F.transform(F.coalesce("article_path_patterns", F.array()), lambda x: F.struct(F.lit(2).alias("rank"), x.alias("rule"), F.lit("article").alias("kind"))),
                F.transform(F.coalesce("sitemap_paths", F.array()), lambda x: F.struct(F.lit(-1).alias("rank"), x.alias("rule"), F.lit("sitemap").alias("kind"))),
            )
        ).alias("r"),
    ).select("host", "id", "r.*")
    by_host = rules.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("id", "rank", "rule", "kind"))).alias("rules"))
    keyed = pages.withColumn("h", urls.host(F.col(url))).withColumn("p", urls.path(F.col(url)))
    looks = F.lower(F.col("p")).endswith(".xml") | F.lower(F.col("p")).contains("sitemap")
    fits = lambda r: F.when(r["rank"] == -1, looks).when(r["rank"] == 0, p == r["rule"]).otherwise(F.rlike("p", r["rule"]))
    joined = keyed.join(small(by_host), keyed["h"] == by_host["host"], "left").drop("host")
    hits = F.filter(F.coalesce("rules", F.array()), fits)
    best = F.coalesce(F.get(F.filter(hits, lambda r: r["rank"] == -1), 0), F.get(hits, 0))
    return joined.withColumn("best", best).withColumn("kind", F.coalesce("best.kind", F.lit("reject"))).withColumn("source_id", F.col("best.id")).drop("h", "p", "rules", "best")


def seeds(pages: DataFrame, catalog: DataFrame, url: str = "url") -> DataFrame:
    """Adds kind and error: listings, articles and sitemaps may be enqueued; what the catalog does not know has an error that names its host."""
    host = F.coalesce(F.nullif(urls.host(F.col(url)), F.lit("")), F.lit("<missing-host>"))
    told = F.when(F.col("kind") == "reject", F.concat(F.lit("not in the catalog of sources: "), host))
    return classify(pages, catalog, url).withColumn("error", told)


def sources_of(catalog: DataFrame) -> DataFrame:
    """host, sources, seeds, sitemaps: what the catalog has for each host; the catalog is a small dimension."""
    at = lambda paths: F.transform(F.coalesce(F.col(paths), F.array()), lambda p: F.concat(F.lit("https://"), F.lower("host"), p))
    rows = catalog.select(F.lower("host").alias("host"), "id", at("listing_paths").alias("s"), at("sitemap_paths").alias("m"))
    gather = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return rows.groupBy("host").agg(F.array_sort(F.collect_list("id")).alias("sources"), gather("s").alias("seeds"), gather("m").alias("sitemaps"))


# Last segments of paths that are no article, and endings of feeds.
UTILITY_SLUGS = ("about", "archive", "articles", "corporate", "discover", "engineering", "feed", "followers", "following", "industry", "latest", "login", "privacy", "product", "search", "subscribe")
FEED_ENDINGS = ("atom", "json", "rss", "xml")


def collectable(pages: DataFrame, catalog: DataFrame, hashed_hosts: tuple[str, ...] = (), url: str = "url") -> DataFrame:
    """Adds collect: whether a source's page is an article to capture.

    Feeds, pages of the site itself and mere locales are none. On ``hashed_hosts`` an article's path ends with a hash; on
    others one of the source's article patterns fits. The catalog is a small dimension.
    """
    path = F.regexp_replace(F.col("_p"), "/+$", "")
    slug = F.lower(F.element_at(F.split(path, "/"), -1))
    ending = F.when(slug.contains("."), F.element_at(F.split(slug, r"\."), -1))
    plain = ~F.coalesce(ending.isin(*FEED_ENDINGS), F.lit(False)) & ~slug.isin(*UTILITY_SLUGS) & ~slug.rlike("^[a-z]{2}(?:-[a-z]{2})?$")
    by_host = catalog.groupBy(F.lower("host").alias("_host")).agg(F.flatten(F.collect_list(F.coalesce("article_path_patterns", F.array()))).alias("_patterns"))
    keyed = pages.withColumn("_h", urls.host(F.col(url))).withColumn("_p", urls.path(F.col(url)))
    fits = F.when(F.col("_h").isin(*hashed_hosts), slug.rlike("-[0-9a-f]{8,}$")) if hashed_hosts else F.when(F.lit(False), F.lit(False))
    told = F.col("_host").isNotNull() & plain & fits.otherwise(F.exists("_patterns", lambda r: F.rlike(F.when(path == "", "/").otherwise(path), r)))
    return keyed.join(small(by_host), F.col("_h") == F.col("_host"), "left").withColumn("collect", F.coalesce(told, F.lit(False))).drop("_h", "_p", "_host", "_patterns")


def sitemap_walk(files: DataFrame, roots: list[str], most: int = 60, limit: int = 1_000) -> DataFrame:
    """url, place: the distinct pages that sitemaps name, in the order in which they are found, ``limit`` at most.

    Indexes are opened breadth first, ``most`` files in all; ``files`` has the captured url and xml. Each level is one
    join; of files only their names come to the driver, ``most`` of them.
    """
    spark = files.sparkSession
    seen: list[str] = []
    queue = list(dict.fromkeys(roots))
    found = None
    while queue and len(seen) < most:
        now = queue[: most - len(seen)]
        level = spark.createDataFrame([(u, len(seen) + i) for i, u in enumerate(now)], "url string, turn int")
        seen += now
        opened = files.join(F.broadcast(level), "url").select("turn", F.regexp_extract("xml", r"(?s)<(?![?!])(?:[\w.-]+:)?([\w.-]+)", 1).alias("root"), F.posexplode(sitemap_locs(F.col("xml"))).alias("at", "loc"))
        inner = opened.where("root = 'sitemapindex'").orderBy("turn", "at").select("loc").limit(most + len(seen)).collect()
        queue = [u for u in dict.fromkeys(r["loc"] for r in inner) if u not in seen]
        leaves = opened.where("root = 'urlset'").select(urls.canonical(F.col("loc")).alias("url"), F.struct("turn", "at").alias("place"))
        found = leaves if found is None else found.union(leaves)
    if found is None:
        return spark.createDataFrame([], "url string, place long")
    first = found.where("url is not null").groupBy("url").agg(F.min("place").alias("place")).orderBy("place").limit(limit)
    from pyspark.sql import Window

    return first.select("url", F.row_number().over(Window.orderBy("place")).cast("long").alias("place"))  # limit rows


def unseen(candidates: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Candidates that were not seen, each once."""
    return candidates.dropDuplicates([key]).join(seen.select(key).distinct(), key, "left_anti")


def links(pages: DataFrame) -> DataFrame:
    """page_id, link: normalised targets of a page's anchors, each once; ``pages`` has page_id, url and html."""
    anchor = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    hrefs = F.filter(F.concat(*(F.regexp_extract_all("html", F.lit(anchor), F.lit(k)) for k in (1, 2))), lambda h: h != "")
    found = pages.select("page_id", "url", F.explode(F.array_distinct(hrefs)).alias("href"))
    plain = F.regexp_replace(F.col("href"), "&amp;", "&")
    return found.select("page_id", "url", urls.normalize(urls.resolve(F.col("url"), plain)).alias("link")).where("link is not null").distinct()


def expand(pages: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """url, depth: what is reached from the seeds over links to the same host, level by level, in captured pages."""
    edges = links(pages).select(urls.normalize(F.col("url")).alias("from"), "link").where(urls.host(F.col("from")) == urls.host(F.col("link")))
    found = seeds.select(urls.normalize(F.col("url")).alias("url"), F.lit(0).alias("depth")).where("url is not null").distinct()
    level = found
    for depth in range(1, max_depth + 1):
        next_ = level.join(edges, level["url"] == edges["from"]).select(F.col("link").alias("url")).distinct().join(found.select("url"), "url", "left_anti")
        level = next_.select("url", F.lit(depth).alias("depth"))
        found = found.union(level)
    return found


def sitemap_locs(xml: Column) -> Column:
    """Distinct locations of a urlset or sitemapindex, whatever its namespace; empty for other roots."""
    root = F.regexp_extract(xml, r"(?s)<(?![?!])(?:[\w.-]+:)?([\w.-]+)", 1)
    found = F.xpath(F.regexp_replace(xml, r"<\?xml[^>]*\?>", ""), F.lit("//*[local-name()='loc']/text()"))
    return F.when(root.isin("urlset", "sitemapindex"), F.array_distinct(F.transform(found, lambda x: F.trim(x)))).otherwise(F.array().cast("array<string>"))


def parse_robots(files: DataFrame) -> DataFrame:
    """host, agent, allow, pattern, crawl_delay, request_rate: a row for each rule; ``files`` has host and text.

    Groups without rules have one row with a null pattern. ``request_rate`` is seconds for a request, rounded up. A file
    whose ``status``, if there is such a column, is 400 or more has no rules: all is allowed.
    """
    if "status" in files.columns:
        files = files.withColumn("text", F.when(F.coalesce("status", F.lit(0)) >= 400, "").otherwise(F.col("text")))
    kind = pa.list_(pa.struct([("agent", pa.string()), ("allow", pa.bool_()), ("pattern", pa.string()), ("crawl_delay", pa.float64()), ("request_rate", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules = [robots_rules(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rules, kind)], ["host", "rules"])

    made = files.select("host", "text").mapInArrow(run, "host string, rules array<struct<agent: string, allow: boolean, pattern: string, crawl_delay: double, request_rate: long>>")
    return made.select("host", F.explode("rules").alias("r")).select("host", "r.*")


def robots_rules(text: str) -> list[dict]:
    out: list[dict] = []
    agents: list[str] = []
    own: list[dict] = []
    delay = rate = None
    fresh = True

    def flush() -> None:
        for agent in agents:
            for rule in own or [{"allow": None, "pattern": None}]:
                out.append({"agent": agent, **rule, "crawl_delay": delay, "request_rate": rate})

    for line in text.splitlines():
        name, _, value = line.split("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            if not fresh:
                flush()
                agents, own, delay, rate = [], [], None, None
            agents.append(value.lower())
            fresh = True
        elif agents and name in ("allow", "disallow", "crawl-delay", "request-rate"):
            fresh = False
            if name == "crawl-delay":
                delay = float(value) if re.fullmatch(r"\d+(\.\d+)?", value) else delay
            elif name == "request-rate":
                rate = request_seconds(value) or rate
            elif value:
                own.append({"allow": name == "allow", "pattern": value})
    flush()
    return out


def request_seconds(rate: str) -> int | None:
    """'n/window' with s, m, h or d as seconds for a request, rounded up."""
    found = re.match(r"(\d+)\s*/\s*(\d+)\s*([smhd]?)", rate.lower())
    if not found or not int(found[1]):
        return None
    window = int(found[2]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[found[3]]
    return -(-window // int(found[1]))


def request_rate(rate: Column) -> Column:
    """The same as an expression."""
    pattern = r"(?i)^(\d{1,9})\s*/\s*(\d{1,9})\s*([smhd]?)"
    number = lambda k: F.when(rate.rlike(pattern), F.regexp_extract(rate, pattern, k)).cast("double")
    unit = F.lower(F.regexp_extract(rate, pattern, 3))
    seconds = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)
    return F.when(number(1) > 0, F.ceil(number(2) * seconds / number(1))).cast("long")


def rule_pattern(rule: Column) -> Column:
    """A robots path pattern as a regular expression: * is anything, a $ at the end is the end."""
    quoted = F.regexp_replace(rule, r"([.+?^(){}\[\]|\\])", r"\\$1")
    open_ = F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\$(?!$)", r"\\\$")
    return F.concat(F.lit("^"), open_)


def allowed(requests: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Adds allowed: by the most specific groups of the agent, the longest pattern that matches, allow before disallow.

    An agent is known by its product, what stands before a slash. A pattern's length is that of its letters, without
    stars and the mark of the end. ``requests`` has host and path (with its query); rules are joined by host.
    """
    fits = F.lit(agent.split("/")[0].lower()).contains(F.col("agent")) & (F.col("agent") != "*")
    specific = F.when(fits, F.length("agent")).when(F.col("agent") == "*", 0)
    mine = rules.withColumn("specific", specific).where("specific is not null")
    best = mine.groupBy("host").agg(F.max("specific").alias("specific"))
    own = mine.join(best, ["host", "specific"]).where("pattern is not null").groupBy("host").agg(F.collect_set(F.struct("allow", "pattern", rule_pattern(F.col("pattern")).alias("re"))).alias("rules"))
    hit = F.filter(F.coalesce("rules", F.array()), lambda r: F.rlike("path", r["re"]))
    longest = F.array_max(F.transform(hit, lambda r: F.struct(F.length(F.regexp_replace(F.replace(r["pattern"], F.lit("*"), F.lit("")), r"\$$", "")).alias("n"), r["allow"].alias("allow"))))
    return requests.join(own, "host", "left").withColumn("allowed", F.coalesce(longest["allow"], F.lit(True))).drop("rules")


def spacing(crawl_delay: Column, rate: Column, default: float = DEFAULT_DELAY) -> Column:
    """Seconds between requests: the larger of both, the default for a delay that is absent or 0."""
    return F.greatest(F.coalesce(F.nullif(crawl_delay, F.lit(0.0)), F.lit(default)), F.coalesce(rate.cast("double"), F.lit(0.0)))


def fetch_outcome(status: Column) -> Column:
    """What a response means for its run: transport errors, 429 and 5xx can be tried again, other 4xx can't."""
    return F.when(status.isNull() | (status == 429) | (status >= 500), "retryable").when(status >= 400, "permanent").otherwise("ok")
