"""Search over ``documents`` and ``embeddings`` (vec_id is a document's id), with SQL to hold each query against."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vector
from tidemark.operators import retrieval as R
from tidemark.sources.tables import scratch, table

TEXT, PREFIX_TEXT, SHORT_TEXT = "the with", "the wi", "the w"
QUERY_VECTOR = 7
K = 10
WEIGHTS = {"title": 2.0, "content": 1.0}
TAGS = {"lang": ["fr"], "source": ["src3", "src5", "src6"]}


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"), F.col("text").alias("content"), "lang", "source")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def asked(spark: SparkSession, d: str) -> list[float]:
    row = vectors(spark, d).where(F.col("doc_id") == QUERY_VECTOR).select("embedding").first()
    return [float(x) for x in row[0]] if row else []


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def stored(spark: SparkSession, d: str) -> R.Index:
    """The index of these tables, written when the first query of an application needs it."""
    path = f"{scratch(spark)}/index-{spark.sparkContext.applicationId}-{zlib.crc32(d.encode())}"
    R.store(documents(spark, d), {f: F.col(f) for f in WEIGHTS}, path)
    return R.opened(spark, path)


def content_index(spark: SparkSession, d: str) -> R.Index:
    made = stored(spark, d)
    return R.Index(made.postings.where("field = 'content'"), made.stats.where("field = 'content'"), True)


def kw_and_match(spark: SparkSession, d: str) -> DataFrame:
    found = R.matching_ids(content_index(spark, d), R.parse(TEXT + " "))
    return documents(spark, d).join(found, "doc_id").groupBy("source").agg(F.count("*").alias("n"))


def kw_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.top(R.bm25(content_index(spark, d), R.parse(TEXT + " "), {"content": 1.0}), K))


def kw_unindexed(spark: SparkSession, d: str) -> DataFrame:
    """The same over the texts themselves, counting the query's words only."""
    query = R.parse(TEXT + " ")
    return rounded(R.top(R.bm25(R.index(documents(spark, d), {"content": F.col("content")}, query), query, {"content": 1.0}), K))


def kw_field_weighted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.top(R.bm25(stored(spark, d), R.parse(TEXT + " "), WEIGHTS), K))


def kw_prefix_expand(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.top(R.bm25(content_index(spark, d), R.parse(PREFIX_TEXT), {"content": 1.0}), K))


def kw_short_last_word(spark: SparkSession, d: str) -> DataFrame:
    """A single trailing character is dropped."""
    return rounded(R.top(R.bm25(content_index(spark, d), R.parse(SHORT_TEXT), {"content": 1.0}), K))


def index_info(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d).info()


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.nearest(vectors(spark, d), asked(spark, d), K))


def knn_text_filtered(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.nearest(vectors(spark, d).join(R.matching_ids(content_index(spark, d), R.parse(TEXT + " ")), "doc_id"), asked(spark, d), K))


def knn_tag_filtered(spark: SparkSession, d: str) -> DataFrame:
    found = R.search(documents(spark, d), vectors(spark, d), TEXT, asked(spark, d), "semantic", K, tags=TAGS)
    return rounded(found.select("doc_id", "score"))


def hybrid_union_rerank(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    found = R.hybrid(stored(spark, d), vectors(spark, d), R.parse(TEXT + " "), asked(spark, d), K, WEIGHTS)
    return rounded(R.hydrate(found, docs.select("doc_id", "title", "source"))).select("doc_id", "title", "source", "score")


def result_snippet(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.snippet(F.col("content"), "the and").alias("snippet"))


def dummy_embedding_dims(spark: SparkSession, d: str) -> DataFrame:
    v = vector.dummy_embedding(F.col("title"))
    return documents(spark, d).select("doc_id", v.alias("v")).select("doc_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.get("v", F.lit(2)), 6).alias("third"))


def embedding_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    pooled = vector.mean_pool(vectors(spark, d), "label", "embedding")
    return pooled.select("label", F.posexplode("mean").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


def embedding_fit_dimension(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return v.select("doc_id", F.size(vector.fit_dimension(F.col("embedding"), 16)).alias("shorter"), vector.fit_dimension(F.col("embedding"), 128).isNull().alias("too_short"), F.round(vector.norm(F.col("embedding")), 5).alias("norm"))


def maxsim_late_interaction(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    query = [[float(x) for x in r[0]] for r in v.where(F.col("doc_id") < 3).orderBy("doc_id").select("embedding").collect()]
    groups = v.where("doc_id >= 3").groupBy((F.col("doc_id") % 50).alias("doc_id")).agg(F.collect_list("embedding").alias("vectors"))
    return rounded(R.late_interaction(groups, query, K))


def hydrate_missing(spark: SparkSession, d: str) -> DataFrame:
    hits = spark.createDataFrame([(i, 100.0 - i) for i in (3, 5, 99, -4, 10**9)], "doc_id long, score double")
    return R.hydrate(hits, documents(spark, d).select("doc_id", "source")).select("doc_id", "score", "source")


def ordered_union_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rank = lambda df: df.selectExpr("doc_id", "row_number() OVER (ORDER BY score DESC, doc_id) AS rank")
    words, near = rank(R.top(R.bm25(content_index(spark, d), R.parse(TEXT + " "), {"content": 1.0}), K)), rank(R.nearest(vectors(spark, d), asked(spark, d), K))
    return R.union_distinct(words, near).selectExpr("doc_id", "at.list AS list", "at.rank AS rank")


def search_api(spark: SparkSession, d: str) -> DataFrame:
    return R.search(documents(spark, d), vectors(spark, d), "the with ", asked(spark, d), "keyword", K, made=stored(spark, d)).select("doc_id", "snippet", "score", F.round("engine_score", 6).alias("engine_score"))


def search_semantic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.search(documents(spark, d), vectors(spark, d), TEXT, asked(spark, d), "semantic", K)).select("doc_id", "title", "score")


def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.search(documents(spark, d), vectors(spark, d), "the with ", asked(spark, d), "hybrid", K, made=stored(spark, d))).select("doc_id", "title", "score")


def search_tagged(spark: SparkSession, d: str) -> DataFrame:
    found = R.search(documents(spark, d), vectors(spark, d), "de la ", asked(spark, d), "keyword", K, tags=TAGS, made=stored(spark, d))
    return found.select("doc_id", F.round("engine_score", 6).alias("engine_score"))


def result_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Hits without an id have their key; authors stand in one text."""
    k = F.col("doc_id")
    hits = documents(spark, d).select(
        F.when(k % 3 > 0, k).alias("doc_id"), F.concat(F.lit("doc:"), k).alias("doc_key"), "title", "content", F.concat(F.lit(" "), "source", F.lit(" , ,"), "lang").alias("authors"), F.when(k % 2 == 0, "").otherwise("2024-01-01").alias("published_at"), F.lit(0.5).alias("score")
    )
    made = R.results(hits, "the with")
    return made.select("doc_id", "title", "url", F.concat_ws("|", "authors").alias("authors"), "company", "published_at", "score")


def topic_tags(spark: SparkSession, d: str) -> DataFrame:
    names = ("the", "With", "idiot", "Licensed")
    return documents(spark, d).select("doc_id", F.concat_ws(",", T.topics(F.col("content"), names)).alias("topics"), F.size(T.topics(F.col("content"))).alias("known"))


_DOCS = "docs AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS content, lang, source FROM documents)"
_TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')"
_QV = "qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)"


def _bm25(fields: dict[str, float], where: str, terms: int) -> str:
    """scored(doc_id, score); ``where`` names the term of a token or null."""
    parts = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {w} AS weight, {_TOKENS.format(f)} AS words FROM docs" for f, w in fields.items())
    return f"""{_DOCS}, f AS ({parts}),
    stats AS (SELECT field, avg(len(words)) AS mean, count(*) AS n FROM f GROUP BY field),
    t AS (SELECT doc_id, field, weight, len(words) AS length, unnest(words) AS token FROM f),
    h AS (SELECT doc_id, field, weight, length, {where} AS term, count(*) AS tf FROM t WHERE {where} IS NOT NULL GROUP BY ALL),
    df AS (SELECT field, term, count(*) AS df FROM h GROUP BY ALL),
    scored AS (SELECT doc_id, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
      FROM h JOIN df USING (field, term) JOIN stats USING (field) GROUP BY doc_id HAVING count(DISTINCT term) = {terms})"""


_BOTH = "CASE WHEN token IN ('the', 'with') THEN token END"
_PREFIX = "CASE WHEN token = 'the' THEN token WHEN starts_with(token, 'wi') THEN 'wi*' END"
_WITH = "CASE WHEN token = 'the' THEN token WHEN starts_with(token, 'with') THEN 'with*' END"
_TOP = "SELECT doc_id, round(score, 6) AS score FROM {0} ORDER BY {0}.score DESC, doc_id LIMIT 10"
_COS = "cos AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, qv)"
_ALL = f"(len(list_intersect({_TOKENS.format('content')}, ['the', 'with'])) = 2)"

SPECS = {
    "kw_and_match": (kw_and_match, f"WITH {_DOCS} SELECT source, count(*) AS n FROM docs WHERE {_ALL} GROUP BY source"),
    "kw_bm25_topk": (kw_bm25_topk, f"WITH {_bm25({'content': 1.0}, _BOTH, 2)} {_TOP.format('scored')}"),
    "kw_unindexed": (kw_unindexed, f"WITH {_bm25({'content': 1.0}, _BOTH, 2)} {_TOP.format('scored')}"),
    "index_info": (
        index_info,
        f"""WITH {_DOCS}, f AS (SELECT 'title' AS field, doc_id, {_TOKENS.format('title')} AS w FROM docs UNION ALL SELECT 'content', doc_id, {_TOKENS.format('content')} FROM docs), t AS (SELECT DISTINCT field, doc_id, unnest(w) AS token FROM f)
        SELECT field, (SELECT count(*) FROM docs) AS documents, count(DISTINCT token) AS tokens, count(*) AS postings FROM t GROUP BY field""",
    ),
    "search_semantic": (search_semantic, f"WITH {_DOCS}, {_QV}, {_COS}, k AS (SELECT doc_id, score FROM cos ORDER BY score DESC, doc_id LIMIT 10) SELECT doc_id, title, round(score, 6) AS score FROM k JOIN docs USING (doc_id)"),
    "search_hybrid": (
        search_hybrid,
        f"""WITH {_bm25(WEIGHTS, _WITH, 2)}, {_QV}, {_COS}, both_ids AS (
          (SELECT doc_id FROM scored ORDER BY score DESC, doc_id LIMIT 50) UNION (SELECT doc_id FROM cos ORDER BY score DESC, doc_id LIMIT 50)),
        k AS (SELECT doc_id, score FROM cos JOIN both_ids USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10)
        SELECT doc_id, title, round(score, 6) AS score FROM k JOIN docs USING (doc_id)""",
    ),
    "search_tagged": (
        search_tagged,
        f"""WITH {_bm25(WEIGHTS, "CASE WHEN token = 'de' THEN token WHEN starts_with(token, 'la') THEN 'la*' END", 2)}
        SELECT doc_id, round(s.score, 6) AS engine_score FROM scored s JOIN docs USING (doc_id) WHERE lang = 'fr' AND source IN ('src3', 'src5', 'src6') ORDER BY s.score DESC, doc_id LIMIT 10""",
    ),
    "result_mapping": (
        result_mapping,
        f"""WITH {_DOCS} SELECT CASE WHEN doc_id % 3 > 0 THEN doc_id::VARCHAR ELSE 'doc:' || doc_id END AS doc_id, coalesce(title, '') AS title, '' AS url, source || '|' || lang AS authors, '' AS company,
          CASE WHEN doc_id % 2 <> 0 THEN '2024-01-01' END AS published_at, 0.5::DOUBLE AS score FROM docs""",
    ),
    "kw_field_weighted": (kw_field_weighted, f"WITH {_bm25(WEIGHTS, _BOTH, 2)} {_TOP.format('scored')}"),
    "kw_prefix_expand": (kw_prefix_expand, f"WITH {_bm25({'content': 1.0}, _PREFIX, 2)} {_TOP.format('scored')}"),
    "kw_short_last_word": (kw_short_last_word, f"""WITH {_bm25({'content': 1.0}, "CASE WHEN token = 'the' THEN token END", 1)} {_TOP.format('scored')}"""),
    "knn_topk": (knn_topk, f"WITH {_QV}, {_COS} {_TOP.format('cos')}"),
    "knn_text_filtered": (knn_text_filtered, f"WITH {_DOCS}, {_QV}, {_COS}, k AS (SELECT cos.* FROM cos JOIN docs USING (doc_id) WHERE {_ALL}) {_TOP.format('k')}"),
    "knn_tag_filtered": (knn_tag_filtered, f"WITH {_DOCS}, {_QV}, {_COS}, k AS (SELECT cos.* FROM cos JOIN docs USING (doc_id) WHERE lang = 'fr' AND source IN ('src3', 'src5', 'src6')) {_TOP.format('k')}"),
    "hybrid_union_rerank": (
        hybrid_union_rerank,
        f"""WITH {_bm25(WEIGHTS, _BOTH, 2)}, {_QV}, {_COS}, both_ids AS (
          (SELECT doc_id FROM scored ORDER BY score DESC, doc_id LIMIT 50) UNION (SELECT doc_id FROM cos ORDER BY score DESC, doc_id LIMIT 50)),
        k AS (SELECT doc_id, score FROM cos JOIN both_ids USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10)
        SELECT doc_id, title, source, round(score, 6) AS score FROM k JOIN docs USING (doc_id)""",
    ),
    "result_snippet": (
        result_snippet,
        f"""WITH {_DOCS}, c AS (SELECT doc_id, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS t FROM docs),
        h AS (SELECT *, instr(lower(t), 'the and') AS hit FROM c), w AS (SELECT *, greatest(1, hit - 66) AS s FROM h), e AS (SELECT *, least(length(t), s + 199) AS e FROM w)
        SELECT doc_id, CASE WHEN hit > 0 THEN CASE WHEN s > 1 THEN '…' ELSE '' END || trim(substr(t, s, e - s + 1)) || CASE WHEN e < length(t) THEN '…' ELSE '' END
          ELSE trim(substr(t, 1, 200)) END AS snippet FROM e""",
    ),
    "dummy_embedding_dims": (
        dummy_embedding_dims,
        f"""WITH {_DOCS}, v AS (SELECT doc_id, list_transform(range(1, 385), lambda i: CASE WHEN i <= length(title) THEN (unicode(substr(title, i, 1)) % 97) / 96.0 ELSE 0.0 END::DOUBLE) AS v FROM docs)
        SELECT doc_id, len(v)::INT AS dim, round(list_sum(v), 6) AS total, round(v[3], 6) AS third FROM v""",
    ),
    "embedding_mean_pool": (embedding_mean_pool, "SELECT label, (i - 1)::INT AS i, round(avg(x::DOUBLE), 6) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i"),
    "embedding_fit_dimension": (embedding_fit_dimension, "SELECT vec_id AS doc_id, len(embedding[1:16])::INT AS shorter, len(embedding) < 128 AS too_short, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm FROM embeddings"),
    "maxsim_late_interaction": (
        maxsim_late_interaction,
        """WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 3), best AS (
          SELECT vec_id % 50 AS doc_id, qid, max(list_inner_product(embedding::DOUBLE[], q)) AS m FROM embeddings, q WHERE vec_id >= 3 GROUP BY ALL),
        s AS (SELECT doc_id, sum(m) AS score FROM best GROUP BY doc_id) SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 10""",
    ),
    "hydrate_missing": (hydrate_missing, "SELECT doc_id, score, source FROM (VALUES (3, 97.0::DOUBLE), (5, 95.0), (99, 1.0), (-4, 104.0), (1000000000, -999999900.0)) h(doc_id, score) JOIN documents USING (doc_id)"),
    "ordered_union_dedupe": (
        ordered_union_dedupe,
        f"""WITH {_bm25({'content': 1.0}, _BOTH, 2)}, {_QV}, {_COS}, a AS (SELECT doc_id, 0 AS list, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10),
        b AS (SELECT doc_id, 1 AS list, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM cos QUALIFY rank <= 10), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
        SELECT doc_id, list, rank::INT AS rank FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY list) = 1""",
    ),
    "search_api": (
        search_api,
        f"""WITH {_bm25(WEIGHTS, _WITH, 2)}, k AS (SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 10),
        c AS (SELECT doc_id, score, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS t FROM k JOIN docs USING (doc_id)), hh AS (SELECT *, instr(lower(t), 'the with') AS hit FROM c),
        w AS (SELECT *, greatest(1, hit - 66) AS s FROM hh), e AS (SELECT *, least(length(t), s + 199) AS e FROM w)
        SELECT doc_id, CASE WHEN hit > 0 THEN CASE WHEN s > 1 THEN '…' ELSE '' END || trim(substr(t, s, e - s + 1)) || CASE WHEN e < length(t) THEN '…' ELSE '' END
          ELSE trim(substr(t, 1, 200)) END AS snippet, 0.0::DOUBLE AS score, round(score, 6) AS engine_score FROM e""",
    ),
    "topic_tags": (
        topic_tags,
        r"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)\bthe\b') THEN 'the' END, CASE WHEN regexp_matches(text, '(?i)\bwith\b') THEN 'With' END,
          CASE WHEN regexp_matches(text, '(?i)\bidiot\b') THEN 'idiot' END, CASE WHEN regexp_matches(text, '(?i)\blicensed\b') THEN 'Licensed' END) AS topics,
          len(list_filter(['Kafka','Flink','Spark','Redis','Kubernetes','Ray','TensorFlow','PyTorch','GraphQL','React','Rust'], lambda t: regexp_matches(text, '(?i)\b' || t || '\b')))::INT AS known FROM documents""",
    ),
}
