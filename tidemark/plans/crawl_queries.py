"""URLs, robots, frontier and pages over ``pages``, with SQL to hold each query against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators import frontier
from tidemark.sources.tables import table

#: A catalog for the hosts of the test pages.
CATALOG = [
    ("net", "Net", "tionsh.example.net", ["/en/1"], [r"^/en/\d+(?:\.html)?/?$"], [r"^/fr/[0-9]*5$"], ["/sitemap.xml"]),
    ("com-a", "Com", "ththin.example.com", [], [r"^/[a-z]{2}/\d+$"], [], []),
    ("com-b", "Com", "ththin.example.com", [], [r"^/[a-z]{2}/\d+(?:\.html|/)?$"], [], []),
]
ROBOTS = "User-agent: *\nDisallow: /fr/\nAllow: /fr/1\nDisallow: /*.html$\nCrawl-delay: 2\n\nUser-agent: tidebot\nDisallow: /en/\nAllow: /en/*5\nRequest-rate: 3/1m\n"
RATES = [("1/5s",), ("3/1m",), ("7/2h",), ("2/1d",), ("0/1s",), ("x",), ("10/1",), (None,)]


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url")


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.normalize(F.col("url")).alias("url"))


def url_canonical_dupes(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).groupBy(U.canonical(F.col("url")).alias("url")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


def url_classify(spark: SparkSession, d: str) -> DataFrame:
    catalog = spark.createDataFrame(CATALOG, frontier.CATALOG)
    return frontier.classify(pages(spark, d), catalog).select("page_id", "kind", "source_id")


def seed_kinds(spark: SparkSession, d: str) -> DataFrame:
    catalog = spark.createDataFrame(CATALOG, frontier.CATALOG)
    return frontier.seeds(pages(spark, d), catalog).select("page_id", "kind", "error")


def catalog_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Every nation is a source of one of five hosts."""
    k = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(
        F.format_string("s%02d", k).alias("id"), F.concat(F.lit("Host"), F.col("n_regionkey"), F.lit(".example")).alias("host"), F.array(F.concat(F.lit("/l"), k % 3)).alias("listing_paths"), F.when(k % 2 == 0, F.array(F.lit("/sitemap.xml"))).alias("sitemap_paths")
    )
    return frontier.sources_of(rows).select("host", *(F.concat_ws(";", c).alias(c) for c in ("sources", "seeds", "sitemaps")))


def collectable_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of two hosts, one with hashes at the ends of its articles' paths."""
    k = F.col("page_id")
    slug = F.when(k % 7 == 0, "en").when(k % 7 == 1, "feed.xml").when(k % 7 == 2, "latest").when(k % 7 == 3, F.concat(F.lit("story-"), F.substring(F.sha2(k.cast("string"), 256), 1, 10))).otherwise(F.concat(F.lit("p"), k))
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://"), F.when(k % 2 == 0, "H.example").when(k % 5 == 0, "none.example").otherwise("p.example"), F.lit("/blog/"), slug, F.lit("/")).alias("url"))
    catalog = spark.createDataFrame([("h", "H", "h.example", None, None, None, None), ("p", "P", "p.example", None, [r"^/blog/[^/]+$"], None, None)], frontier.CATALOG)
    return frontier.collectable(rows, catalog, ("h.example",)).select("page_id", "collect")


def sitemap_walked(spark: SparkSession, d: str) -> DataFrame:
    """An index of the nations' sitemaps, which name their customers; the first 500 pages."""
    entry = lambda at: F.concat(F.lit("<url><loc> "), at, F.lit(" </loc></url>"))
    at = lambda c: F.concat(F.lit("https://h.example/s"), c, F.lit(".xml"))
    page = F.concat(F.lit("https://h.example/"), F.col("c_custkey"), F.lit("/"))
    leaf = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", entry(page).alias("x")))).alias("l"))
    leaves = leaf.select(at(F.col("c_nationkey")).alias("url"), F.concat(F.lit("<urlset>"), F.array_join(F.transform("l", lambda x: x["x"]), ""), F.lit("</urlset>")).alias("xml"))
    top = table(spark, d, "nation").agg(F.array_sort(F.collect_list("n_nationkey")).alias("l"))
    root = top.select(F.lit("root").alias("url"), F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform("l", lambda k: F.concat(F.lit("<sitemap><loc>"), at(k), F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml"))
    return frontier.sitemap_walk(root.union(leaves), ["root", "absent"], 60, 500)


def url_company(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.company(F.col("url")).alias("company"), U.company(F.concat(F.lit("https://meta"), F.col("page_id").cast("string"), F.lit(".example/x"))).alias("other"))


def origin_id(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).groupBy(U.origin_id(F.col("url")).alias("origin_id")).agg(F.count("*").alias("n"))


def url_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2("url", 256).alias("url_hash"), F.sha2("html", 256).alias("html_hash"))


def frontier_anti_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = url_normalize(spark, d)
    return frontier.unseen(rows.select("url"), rows.where("page_id % 3 = 0").select("url"))


def links_same_host(spark: SparkSession, d: str) -> DataFrame:
    found = frontier.links(table(spark, d, "pages"))
    return found.where(U.host(F.col("url")) == U.host(F.col("link"))).groupBy(U.host(F.col("link")).alias("host")).agg(F.count_distinct("link").alias("n"))


def link_count(spark: SparkSession, d: str) -> DataFrame:
    return frontier.links(table(spark, d, "pages")).groupBy("page_id").agg(F.count("*").alias("n"))


def frontier_expand(spark: SparkSession, d: str) -> DataFrame:
    """Links of captured pages, one level deep."""
    rows = table(spark, d, "pages")
    return frontier.expand(rows, rows.where("page_id % 10 = 0").select("url"), 1).groupBy("depth").agg(F.count("*").alias("n"))


def sitemap_locs(spark: SparkSession, d: str) -> DataFrame:
    entry = F.concat(F.lit("<url><loc> "), F.regexp_replace("url", "&", "&amp;"), F.lit(" </loc></url>"))
    head = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    files = pages(spark, d).groupBy(U.host(F.col("url")).alias("host")).agg(F.concat(F.lit(head), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml"))
    return files.select("host", F.explode(frontier.sitemap_locs(F.col("xml"))).alias("url"))


def robots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    requests = pages(spark, d).select("page_id", U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"))
    files = requests.select("host").distinct().where("host like '%example.com'").withColumn("text", F.lit(ROBOTS))
    return requests, frontier.parse_robots(files)


def robots_longest_match(spark: SparkSession, d: str) -> DataFrame:
    requests, rules = robots(spark, d)
    return frontier.allowed(requests, rules, "Otherbot/1.0").select("page_id", "allowed")


def robots_own_group(spark: SparkSession, d: str) -> DataFrame:
    requests, rules = robots(spark, d)
    return frontier.allowed(requests, rules, "Mozilla (tidebot/2)").select("page_id", "allowed")


def effective_delay(spark: SparkSession, d: str) -> DataFrame:
    requests, rules = robots(spark, d)
    by_host = rules.groupBy("host", "agent").agg(F.max("crawl_delay").alias("delay"), F.max("request_rate").alias("rate"))
    return by_host.select("host", "agent", frontier.spacing(F.col("delay"), F.col("rate")).alias("seconds"))


def request_rate_ceil(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(RATES, "rate string").select("rate", frontier.request_rate(F.col("rate")).alias("seconds"))


def fetch_outcome(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("event_id") % 6 * 100 + F.col("event_id") % 30)
    return table(spark, d, "events").groupBy(frontier.fetch_outcome(status).alias("outcome")).agg(F.count("*").alias("n"))


def crawl_pages_by_domain(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


_SCHEME = r"lower(regexp_extract(url, '^([A-Za-z]+)://', 1))"
_AUTH = r"lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"
_PATH = r"regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_BARE = f"regexp_replace({_PATH}, '/+$', '')"
_NORM = f"{_SCHEME} || '://' || regexp_replace({_AUTH}, CASE WHEN {_SCHEME} = 'http' THEN ':80$' ELSE ':443$' END, '') || CASE WHEN {_BARE} = '' THEN '/' ELSE {_BARE} END || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END"
_LINKS = f"""l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
 n AS (SELECT DISTINCT page_id, {_AUTH} AS host, {_SCHEME} || '://' || {_AUTH} || CASE WHEN regexp_replace(href, '/+$', '') = '' THEN '/' ELSE regexp_replace(href, '/+$', '') END AS link FROM l WHERE starts_with(href, '/'))"""

SPECS = {
    "url_normalize": (url_normalize, f"SELECT page_id, {_NORM} AS url FROM pages"),
    "url_canonical_dupes": (url_canonical_dupes, f"SELECT {_SCHEME} || '://' || {_AUTH} || {_BARE} AS url, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1"),
    "url_classify": (
        url_classify,
        rf"""WITH p AS (SELECT page_id, {_AUTH} AS h, {_PATH} AS p, {_BARE} AS b FROM pages)
        SELECT page_id, CASE WHEN h = 'tionsh.example.net' THEN CASE WHEN lower(p) LIKE '%.xml' OR lower(p) LIKE '%sitemap%' THEN 'sitemap' WHEN b = '/en/1' OR regexp_matches(p, '^/fr/[0-9]*5$') THEN 'listing' WHEN regexp_matches(p, '^/en/\d+(?:\.html)?/?$') THEN 'article' ELSE 'reject' END
          WHEN h = 'ththin.example.com' AND regexp_matches(p, '^/[a-z]{{2}}/\d+(?:\.html|/)?$') THEN 'article' ELSE 'reject' END AS kind,
        CASE WHEN h = 'tionsh.example.net' THEN CASE WHEN lower(p) LIKE '%.xml' OR lower(p) LIKE '%sitemap%' OR b = '/en/1' OR regexp_matches(p, '^/fr/[0-9]*5$') OR regexp_matches(p, '^/en/\d+(?:\.html)?/?$') THEN 'net' END
          WHEN h = 'ththin.example.com' THEN CASE WHEN regexp_matches(p, '^/[a-z]{{2}}/\d+$') THEN 'com-a' WHEN regexp_matches(p, '^/[a-z]{{2}}/\d+(?:\.html|/)?$') THEN 'com-b' END END AS source_id FROM p""",
    ),
    "seed_kinds": (
        seed_kinds,
        r"""WITH p AS (SELECT page_id, lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h, regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM pages), b AS (SELECT *, regexp_replace(p, '/+$', '') AS b FROM p),
        k AS (SELECT page_id, h, CASE WHEN h = 'tionsh.example.net' THEN CASE WHEN lower(p) LIKE '%.xml' OR lower(p) LIKE '%sitemap%' THEN 'sitemap' WHEN b = '/en/1' OR regexp_matches(p, '^/fr/[0-9]*5$') THEN 'listing' WHEN regexp_matches(p, '^/en/\d+(?:\.html)?/?$') THEN 'article' ELSE 'reject' END
          WHEN h = 'ththin.example.com' AND regexp_matches(p, '^/[a-z]{2}/\d+(?:\.html|/)?$') THEN 'article' ELSE 'reject' END AS kind FROM b)
        SELECT page_id, kind, CASE WHEN kind = 'reject' THEN 'not in the catalog of sources: ' || CASE WHEN h = '' THEN '<missing-host>' ELSE h END END AS error FROM k""".replace("\\\\", "\\"),
    ),
    "catalog_hosts": (
        catalog_hosts,
        """WITH n AS (SELECT *, 'host' || n_regionkey || '.example' AS host, printf('s%02d', n_nationkey) AS id FROM nation)
        SELECT host, string_agg(id, ';' ORDER BY id) AS sources, string_agg(DISTINCT 'https://host' || n_regionkey || '.example/l' || n_nationkey % 3, ';' ORDER BY 'https://host' || n_regionkey || '.example/l' || n_nationkey % 3) AS seeds,
          coalesce(max(CASE WHEN n_nationkey % 2 = 0 THEN 'https://host' || n_regionkey || '.example/sitemap.xml' END), '') AS sitemaps FROM n GROUP BY host, n_regionkey""",
    ),
    "collectable_pages": (
        collectable_pages,
        "SELECT page_id, CASE WHEN page_id % 7 < 3 THEN false WHEN page_id % 2 = 0 THEN page_id % 7 = 3 ELSE page_id % 5 <> 0 END AS collect FROM pages",
    ),
    "sitemap_walked": (
        sitemap_walked,
        "SELECT url, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS place FROM (SELECT 'https://h.example/' || c_custkey AS url, c_nationkey, c_custkey FROM customer) ORDER BY c_nationkey, c_custkey LIMIT 500",
    ),
    "url_company": (url_company, f"SELECT page_id, CASE WHEN {_AUTH} LIKE '%meta%' THEN 'Meta' ELSE {_AUTH} END AS company, 'Meta' AS other FROM pages"),
    "origin_id": (origin_id, f"SELECT 'o_' || sha256({_SCHEME} || '://' || {_AUTH}) AS origin_id, count(*) AS n FROM pages GROUP BY 1"),
    "url_hash": (url_hash, "SELECT page_id, sha256(url) AS url_hash, sha256(html) AS html_hash FROM pages"),
    "frontier_anti_seen": (frontier_anti_seen, f"SELECT DISTINCT {_NORM} AS url FROM pages EXCEPT SELECT {_NORM} FROM pages WHERE page_id % 3 = 0"),
    "links_same_host": (links_same_host, f"WITH {_LINKS} SELECT host, count(DISTINCT link) AS n FROM n GROUP BY host"),
    "link_count": (link_count, f"WITH {_LINKS} SELECT page_id, count(*) AS n FROM n GROUP BY page_id"),
    "frontier_expand": (
        frontier_expand,
        f"""WITH {_LINKS}, s AS (SELECT DISTINCT {_NORM} AS u FROM pages WHERE page_id % 10 = 0), own AS (SELECT page_id, {_NORM} AS u FROM pages),
        one AS (SELECT DISTINCT link FROM n JOIN own USING (page_id) JOIN s USING (u) WHERE link NOT IN (SELECT u FROM s))
        SELECT 0 AS depth, count(*) AS n FROM s UNION ALL SELECT 1, count(*) FROM one""",
    ),
    "sitemap_locs": (sitemap_locs, f"SELECT DISTINCT {_AUTH} AS host, url FROM pages"),
    "robots_longest_match": (
        robots_longest_match,
        rf"""WITH p AS (SELECT page_id, {_AUTH} AS h, {_PATH} AS p FROM pages), l AS (SELECT *, greatest(CASE WHEN starts_with(p, '/fr/1') THEN 5.5 ELSE 0 END, CASE WHEN starts_with(p, '/fr/') THEN 4 ELSE 0 END, CASE WHEN regexp_matches(p, '^/.*\.html$') THEN 8 ELSE 0 END) AS best FROM p)
        SELECT page_id, h NOT LIKE '%example.com' OR best IN (0, 5.5) AS allowed FROM l""",
    ),
    "robots_own_group": (
        robots_own_group,
        rf"""WITH p AS (SELECT page_id, {_AUTH} AS h, {_PATH} AS p FROM pages)
        SELECT page_id, NOT (h LIKE '%example.com' AND starts_with(p, '/en/') AND NOT regexp_matches(p, '^/en/.*5')) AS allowed FROM p""",
    ),
    "effective_delay": (effective_delay, f"SELECT DISTINCT {_AUTH} AS host, a.agent, a.seconds FROM pages, (VALUES ('*', 2.0::DOUBLE), ('tidebot', 20.0)) a(agent, seconds) WHERE {_AUTH} LIKE '%example.com'"),
    "request_rate_ceil": (
        request_rate_ceil,
        r"""SELECT rate, CASE WHEN regexp_matches(rate, '^[1-9]\d*/') THEN ceil(regexp_extract(rate, '/(\d+)', 1)::DOUBLE * CASE right(rate, 1) WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 ELSE 1 END / regexp_extract(rate, '^(\d+)', 1)::DOUBLE)::BIGINT END AS seconds
        FROM (VALUES ('1/5s'), ('3/1m'), ('7/2h'), ('2/1d'), ('0/1s'), ('x'), ('10/1'), (NULL)) v(rate)""",
    ),
    "fetch_outcome": (
        fetch_outcome,
        """WITH s AS (SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 6 * 100 + event_id % 30 END AS s FROM events)
        SELECT CASE WHEN s IS NULL OR s = 429 OR s >= 500 THEN 'retryable' WHEN s >= 400 THEN 'permanent' ELSE 'ok' END AS outcome, count(*) AS n FROM s GROUP BY 1""",
    ),
    "crawl_pages_by_domain": (crawl_pages_by_domain, f"SELECT {_AUTH} AS host, count(*) AS n FROM pages GROUP BY 1"),
}
