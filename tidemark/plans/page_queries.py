"""HTML trees over ``pages``; SQL holds those queries that patterns over these regular pages can answer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import dom, extraction
from tidemark.sources import tables
from tidemark.sources.tables import table


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def etl_title(spark: SparkSession, d: str) -> DataFrame:
    return dom.documents_of(pages(spark, d)).select("page_id", "title", "language", F.size("authors").alias("authors"))


def etl_content(spark: SparkSession, d: str) -> DataFrame:
    return dom.documents_of(pages(spark, d)).select("page_id", F.length("content").alias("n"), F.col("content").contains("©").alias("footer"))


def nav_dropped_text_len(spark: SparkSession, d: str) -> DataFrame:
    nodes = dom.nodes_of(pages(spark, d))
    return nodes.where("kept").groupBy("page_id").agg(F.sum((F.col("tag") == "nav").cast("int")).alias("navs"), F.sum((F.col("tag") == "p").cast("int")).alias("paragraphs"), F.sum((F.col("tag") == "h1").cast("int")).alias("titles"))


def dom_nodes(spark: SparkSession, d: str) -> DataFrame:
    return dom.nodes_of(pages(spark, d)).select("page_id", "node_id", "parent_id", "depth", "subtree_end", "tag", "direct_text_len", "kept")


def dom_tags(spark: SparkSession, d: str) -> DataFrame:
    return dom.nodes_of(pages(spark, d)).where(F.col("tag").isin("li", "a", "p", "br", "b", "article", "h1", "ul", "nav", "footer")).groupBy("tag").agg(F.count("*").alias("n"))


def dom_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return dom.nearest_ancestors(dom.nodes_of(pages(spark, d))).groupBy("page_id", "distance").agg(F.count("*").alias("n"))


def dom_siblings(spark: SparkSession, d: str) -> DataFrame:
    return dom.siblings(dom.nodes_of(pages(spark, d))).groupBy("tag", "previous_tag", "next_tag").agg(F.count("*").alias("n"))


def dom_features(spark: SparkSession, d: str) -> DataFrame:
    return dom.features(pages(spark, d)).select("page_id", "node_id", F.size("numbers").alias("n"), F.round(F.aggregate("numbers", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


def readable_text(spark: SparkSession, d: str) -> DataFrame:
    def work(html: str | None) -> str:
        nodes = dom.parse(html)
        dom.strip_chrome(nodes)
        return dom.readable_text(nodes, 0)

    import pyarrow as pa

    return dom._per_page(pages(spark, d), "page_id", work, pa.string(), "string", "text")


def json_ld_authors(spark: SparkSession, d: str) -> DataFrame:
    import pyarrow as pa

    block = '<script type="application/ld+json">{"@type":"BlogPosting","author":[{"name":"Ada Lovelace"},{"name":"Data Team"},"Alan Turing"]}</script>'
    marked = pages(spark, d).withColumn("html", F.concat(F.lit(block), "html"))
    return dom._per_page(marked, "page_id", dom.json_ld_authors, pa.list_(pa.string()), "array<string>", "names").select("page_id", F.concat_ws(";", "names").alias("names"))


def heuristic_select(spark: SparkSession, d: str) -> DataFrame:
    rows = dom.features(pages(spark, d))
    scored = rows.select("page_id", "node_id", dom.heuristic_scores(rows).alias("scores"))
    return dom.select(scored, [0.0, 1.0, 0.5, 0.5]).select("page_id", "field", "node_id", F.round("confidence", 6).alias("confidence"))


def mlp_select(spark: SparkSession, d: str) -> DataFrame:
    rng = np.random.default_rng(0)
    n = len(dom.FEATURES)
    network = dom.Network(rng.normal(size=(n, 36)) / n, np.zeros(36), rng.normal(size=(36, 4)) / 6, np.zeros(4), np.zeros(4))
    return dom.select(dom.score_nodes(dom.features(pages(spark, d)), network), [0.0] * 4)


_COUNT = "len(regexp_extract_all(html, '<{0}[ >]'))"
SPECS = {
    "etl_title": (etl_title, "SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS language, 0 AS authors FROM pages"),
    "etl_content": (
        etl_content,
        r"""WITH a AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g') AS t FROM pages),
        u AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM a)
        SELECT page_id, length(t)::INT AS n, contains(t, '©') AS footer FROM u""",
    ),
    "nav_dropped_text_len": (nav_dropped_text_len, "SELECT page_id, 0::BIGINT AS navs, (len(regexp_extract_all(html, '<p>')) - len(regexp_extract_all(html, '<p></p>')))::BIGINT AS paragraphs, 1::BIGINT AS titles FROM pages"),
    "dom_nodes": (dom_nodes, None),
    "dom_tags": (dom_tags, " UNION ALL ".join(f"SELECT '{t}' AS tag, sum({_COUNT.format(t)})::BIGINT AS n FROM pages" for t in ("li", "a", "p", "br", "b", "article", "h1", "ul", "nav", "footer"))),
    "dom_ancestors": (dom_ancestors, None),
    "dom_siblings": (dom_siblings, None),
    "dom_features": (dom_features, None),
    "readable_text_tables": (readable_text, None),
    "json_ld_authors": (json_ld_authors, "SELECT page_id, 'Ada Lovelace;Alan Turing' AS names FROM pages"),
    "heuristic_select": (heuristic_select, None),
    "mlp_select": (mlp_select, None),
}


def css_selectors(spark: SparkSession, d: str) -> DataFrame:
    return extraction.selectors(pages(spark, d))


def extract_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d).select("page_id", "html", F.lit("2024-01-01").cast("timestamp").alias("scraped_at"))
    out = extraction.extract(rows)
    return out.select("page_id", "error", F.col("title.text").alias("title"), F.length("body.text").alias("body"), F.col("date.text").alias("date"), F.col("byline.text").alias("byline"), "published")


def extract_titles(spark: SparkSession, d: str) -> DataFrame:
    """The pages' headings, found by the weight-free scores; white space as the page has it collapsed."""
    rows = pages(spark, d).select("page_id", "html", F.lit("2024-01-01").cast("timestamp").alias("scraped_at"))
    found = extraction.extract_all(rows).where("field = 'title'")
    return found.select("page_id", "text", F.col("html").startswith("<h1>").alias("heading"))


def scored_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All fields by a scorer of the full shape with fixed random weights."""
    rng = np.random.default_rng(3)
    tags = {t: i for i, t in enumerate(("[document]", "a", "article", "b", "body", "div", "footer", "h1", "html", "li", "nav", "p", "ul"), 2)}
    tokens = {t: i for i, t in enumerate(("role:title", "shape:short_text", "shape:medium_text", "shape:long_text", "shape:very_long_text"), 2)}
    n = len(dom.FEATURES)
    draw = lambda *shape: rng.normal(size=shape) / 4
    scorer = dom.Scorer(tags, tokens, draw(len(tags) + 2, 6), draw(len(tokens) + 2, 4), np.zeros(n), np.ones(n), [(draw(38 + n, 36), draw(36)), (draw(36, 36), draw(36)), (draw(36, 4), draw(4))], np.zeros(4))
    rows = pages(spark, d).select("page_id", "html", F.lit("2024-01-01").cast("timestamp").alias("scraped_at"))
    return extraction.extract_all(rows, scorer).select("page_id", "field", "node_id", F.round("confidence", 6).alias("confidence"))


def tightest_heading(spark: SparkSession, d: str) -> DataFrame:
    found = extraction.tightest(dom.nodes_of(pages(spark, d)), F.col("tag").isin("h1", "article"))
    return found.join(dom.nodes_of(pages(spark, d)).select("page_id", "node_id", "tag"), ["page_id", "node_id"]).groupBy("tag").agg(F.count("*").alias("n"))


def title_variants(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("The name of "), F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, " | Site").otherwise(" - Some Blog")).alias("t"))
    return rows.select("c_custkey", F.concat_ws(";", extraction.title_variants(F.col("t"))).alias("variants"))


def title_rerank(spark: SparkSession, d: str) -> DataFrame:
    rows = dom.documents_of(pages(spark, d)).select("page_id", "title", F.split("content", r"\.")[0].alias("start"))
    better = extraction.better_title(F.col("start"), extraction.title_variants(F.col("title")), F.col("title"))
    return rows.select("page_id", (better == F.col("title")).alias("reranked"))


def date_selection(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("page_id"), F.col("o_orderkey").alias("node_id"), F.date_format(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")), "'on' MMMM d, yyyy").alias("text"))
    return extraction.pick_date(o)


def boundary_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select((F.col("o_orderkey") % 5).alias("gold"), (F.col("o_orderkey") % 3).alias("before"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey") % 5).alias("after"))
    return extraction.boundary_report(rows)


def folded_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "text")
    return extraction.folded_tokens(rows, "text", "tokens").select("doc_id", F.size("tokens").alias("n"))


def label_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("page_id"), F.col("doc_id").alias("node_id"), "text")
    return extraction.rank_for_labels(rows, F.col("node_id") % 10, 20, 30_000).select("page_id", "node_id", "rank")


def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    """A manifest with the pages' hashes, some of them broken, and the rules that its rows break."""
    digest = F.when(F.col("page_id") % 10 == 0, "none").otherwise(F.sha2("html", 256))
    rows = pages(spark, d).select(F.col("page_id").cast("string").alias("page_id"), "url", digest.alias("html_hash"))
    return tables.checked(rows, {"html_hash": F.col("html_hash").rlike("^[0-9a-f]{64}$")}).groupBy(F.concat_ws(",", "errors").alias("errors")).agg(F.count("*").alias("n"))


def author_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Refines the article element by a ranker with fixed random weights."""
    nodes = dom.nodes_of(pages(spark, d))
    seeds = nodes.where("tag = 'article'").select("page_id", "node_id")
    rng = np.random.default_rng(1)
    n = 2 * len(dom.FEATURES) + 1
    ranker = dom.Network(rng.normal(size=(n, 24)) / n, np.zeros(24), rng.normal(size=(24, 1)), np.zeros(1), np.zeros(1))
    return extraction.refine_boundary(extraction.local_candidates(nodes, seeds), dom.features(pages(spark, d)), ranker, 0.05)


def local_candidates(spark: SparkSession, d: str) -> DataFrame:
    nodes = dom.nodes_of(pages(spark, d), text=False)
    found = extraction.local_candidates(nodes, nodes.where("tag = 'h1'").select("page_id", "node_id"))
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.max("distance").alias("furthest"))


def byline_rescue(spark: SparkSession, d: str) -> DataFrame:
    """Pages marked with an author whose name is in their heading: the heading is the byline's tightest node."""
    named = pages(spark, d).select("page_id", F.regexp_replace("html", "<h1>", "<h1>Ada Lovelace ").alias("html"))
    nodes, bare = dom.nodes_of(named), dom.nodes_of(named, text=False)
    names = named.select("page_id", F.array(F.lit("Ada Lovelace")).alias("names"))
    chosen = bare.where("tag = 'article'").select("page_id", "node_id")
    found = extraction.rescue_byline(nodes, names, chosen)
    return found.join(bare.select("page_id", "node_id", "tag"), ["page_id", "node_id"]).groupBy("tag").agg(F.count("*").alias("n"))


def attribute_tokens(spark: SparkSession, d: str) -> DataFrame:
    marked = pages(spark, d).select("page_id", F.regexp_replace("html", "<article>", "<article class='postBody main-text' id=main role=main>").alias("html"))
    nodes = dom.nodes_of(marked).where(F.col("tag").isin("article", "div", "p"))
    return nodes.groupBy("tag", F.concat_ws(" ", dom.attribute_tokens(F.col("attrs"))).alias("tokens")).agg(F.count_distinct("page_id").alias("pages"))


SPECS |= {
    "attribute_tokens": (attribute_tokens, "SELECT tag, tokens, count(*) AS pages FROM (SELECT 'article' AS tag, 'post body main text' AS tokens FROM pages UNION ALL SELECT 'div', 'ad' FROM pages UNION ALL SELECT 'p', '' FROM pages) GROUP BY ALL"),
    "author_boundary": (author_boundary, None),
    "local_candidates": (local_candidates, "SELECT page_id, 4::BIGINT AS n, 3 AS furthest FROM pages"),
    "byline_rescue": (
        byline_rescue,
        r"""WITH a AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g') AS t FROM pages),
        u AS (SELECT trim(regexp_replace(replace(replace(t, '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM a)
        SELECT CASE WHEN length(t) + 13 <= 250 THEN 'article' ELSE 'h1' END AS tag, count(*) AS n FROM u GROUP BY 1""",
    ),
    "css_selectors": (css_selectors, None),
    "extract_documents": (extract_documents, None),
    "extract_titles": (extract_titles, "SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text, true AS heading FROM pages"),
    "scored_nodes": (scored_nodes, None),
    "tightest_heading": (tightest_heading, "SELECT 'h1' AS tag, count(*) AS n FROM pages"),
    "title_variants": (title_variants, "SELECT c_custkey, 'The name of ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN ' | Site' ELSE ' - Some Blog' END || ';The name of ' || c_name AS variants FROM customer"),
    "title_rerank": (title_rerank, None),
    "date_selection": (
        date_selection,
        "WITH g AS (SELECT o_custkey % 50 AS page_id, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS iso, count(*) AS n, min(o_orderkey) AS node_id FROM orders GROUP BY ALL) SELECT page_id, iso, node_id FROM g QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, node_id) = 1",
    ),
    "boundary_report": (
        boundary_report,
        """WITH r AS (SELECT o_orderkey % 5 AS g, o_orderkey % 3 AS b, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 5 END AS a FROM orders)
        SELECT count(*) AS n, sum((b IS DISTINCT FROM a)::INT)::BIGINT AS changed, sum((a IS NOT DISTINCT FROM g AND b <> g)::INT)::BIGINT AS fixed, sum((b = g AND a IS DISTINCT FROM g)::INT)::BIGINT AS broken, sum((b <> g)::INT)::BIGINT AS fixable FROM r""",
    ),
    "folded_tokens": (folded_tokens, "SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'))::INT AS n FROM documents"),
    "label_candidates": (
        label_candidates,
        """WITH r AS (SELECT source AS page_id, doc_id AS node_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id % 10 DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20),
        u AS (SELECT *, sum(n) OVER (PARTITION BY page_id ORDER BY rank) AS used FROM r) SELECT page_id, node_id, rank::INT AS rank FROM u WHERE used <= 30000""",
    ),
    "manifest_check": (manifest_check, "SELECT CASE WHEN page_id % 10 = 0 THEN 'html_hash' ELSE '' END AS errors, count(*) AS n FROM pages GROUP BY 1"),
}
