"""Keyword, semantic, hybrid and late-interaction search.

An index is two tables: postings (token, field, doc_id, tf, length of the field) and statistics of the fields. It can be
written once: postings then lie in buckets by their tokens' first two characters, so that a query reads the few parts
that have its words, a prefix too. Without a stored index a query counts its own words only, before
anything is shuffled. BM25 has k1 = 1.2 and b = 0.75; fields add up by their weights. Ids are ranked first, and only the
winners are joined back to their texts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vector
from tidemark.functions.text import snippet, tokens
from tidemark.sources.tables import exists

K1, B = 1.2, 0.75
#: Candidates of either kind for each result of a hybrid search.
WIDE = 5
MODES = ("keyword", "semantic", "hybrid")
#: Buckets of a stored index.
BUCKETS = 64
#: Bytes of text whose postings a task of ``store`` writes, and those from which small tables are cut for more cores.
PART_BYTES, LEAST_BYTES = 32 << 20, 4 << 20


@dataclass
class Query:
    terms: list[str]
    prefix: str | None


def parse(text: str, documented: bool = False) -> Query:
    """Words, and the last one as a prefix if it has two characters; a single trailing character is dropped.

    ``documented`` keeps it as a prefix, as the description of the syntax says.
    """
    words = re.findall(r"[^\W]+", text.lower())
    if not words:
        return Query([], None)
    if text[-1:].isspace() or not re.match(r"\w", text[-1]):
        return Query(words, None)
    last = words.pop()
    if len(last) >= 2 or documented:
        return Query(words, last)
    return Query(words, None)


@dataclass
class Index:
    postings: DataFrame  # token, field, doc_id, tf, length
    stats: DataFrame  # field, n, mean: a row for each field
    bucketed: bool = False

    def info(self) -> DataFrame:
        """field, documents, tokens, postings: how much is in the index."""
        n = self.postings.groupBy("field").agg(F.count("*").alias("postings"), F.count_distinct("token").alias("tokens"))
        return self.stats.join(n, "field", "left").select("field", F.col("n").alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("postings", F.lit(0)).alias("postings"))


def _fields(docs: DataFrame, fields: dict[str, Column]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(n).alias("field"), tokens(c).alias("words")) for n, c in fields.items()))
    return docs.select("doc_id", F.explode(each).alias("f")).select("doc_id", "f.field", "f.words")


def index(docs: DataFrame, fields: dict[str, Column], query: Query | None = None) -> Index:
    """An index of the named fields; with a query, of its words only: counted inside each text, so nothing is shuffled."""
    flat = _fields(docs, fields)
    stats = flat.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    if query is None:
        each = flat.select("doc_id", "field", F.size("words").alias("length"), F.explode("words").alias("token"))
        return Index(each.groupBy("token", "field", "doc_id", "length").agg(F.count("*").alias("tf")), stats)
    hit = F.filter("words", lambda w: wanted(w, query))
    counted = F.transform(F.array_distinct("hit"), lambda t: F.struct(t.alias("token"), F.size(F.filter("hit", lambda u: u == t)).cast("long").alias("tf")))
    found = flat.select("doc_id", "field", F.size("words").alias("length"), hit.alias("hit")).where(F.size("hit") > 0)
    each = found.select("doc_id", "field", "length", F.explode(counted).alias("c"))
    return Index(each.select("c.token", "field", "doc_id", "length", "c.tf"), stats)


def wanted(token: Column, query: Query) -> Column:
    keep = token.isin(query.terms) if query.terms else F.lit(False)
    return keep if query.prefix is None else keep | token.startswith(query.prefix)


def bucket(token: Column) -> Column:
    """By the first two characters, as a prefix has two at least."""
    return F.pmod(F.xxhash64(F.substring(token, 1, 2)), F.lit(BUCKETS)).cast("int")


def counted(flat: DataFrame) -> DataFrame:
    """Postings of texts' words, counted inside each text: as runs of its sorted words, so that nothing is shuffled or kept."""
    words = flat.where(F.size("words") > 0).select("doc_id", "field", F.size("words").alias("length"), F.sort_array("words").alias("w"))
    begins = F.filter(F.sequence(F.lit(1), F.col("length")), lambda i: (i == 1) | (F.element_at("w", i) != F.element_at("w", F.greatest(i - 1, F.lit(1)))))
    runs = words.select("*", begins.alias("at"))
    each = F.transform("at", lambda i, k: F.struct(F.element_at("w", i).alias("token"), (F.coalesce(F.get("at", k + 1), F.col("length") + 1) - i).cast("long").alias("tf")))
    return runs.select("doc_id", "field", "length", F.explode(each).alias("c")).select("c.token", "field", "doc_id", "length", "c.tf")


def store(docs: DataFrame, fields: dict[str, Column], path: str) -> None:
    """Write an index unless there is one.

    Texts are dealt out in parts of bounded size, and each part's postings are put in buckets and written by the task that has its
    texts. So texts are shuffled, not their postings, and a part of a bucket is a file, however frequent a token is.
    """
    spark = docs.sparkSession
    if exists(spark, f"{path}/stats/_SUCCESS"):
        return
    texts = docs.select("doc_id", *(c.alias(n) for n, c in fields.items()))
    size = sum((F.coalesce(F.octet_length(F.col(n)), F.lit(0)).cast("long") for n in fields), F.lit(0))
    each = texts.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    rows, whole, most = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)), F.max("n")).first()
    parts = max(1, -(-whole // PART_BYTES), min(spark.sparkContext.defaultParallelism, -(-whole // LEAST_BYTES)))
    made = counted(_fields(texts.repartition(parts, "doc_id", *fields), {n: F.col(n) for n in fields}))
    if most and most > 1:  # rows with one id and as many words are one document's, as in an index that is not stored
        made = made.groupBy("token", "field", "doc_id", "length").agg(F.sum("tf").alias("tf"))
    made.withColumn("bucket", bucket(F.col("token"))).sortWithinPartitions("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    words = {r["field"]: r["words"] for r in spark.read.parquet(f"{path}/postings").groupBy("field").agg(F.sum("tf").alias("words")).collect()} if whole else {}
    stats = [(n, rows, words.get(n, 0) / rows) for n in fields if rows]
    spark.createDataFrame(stats, "field string, n long, mean double").write.mode("overwrite").parquet(f"{path}/stats")


def opened(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"), True)


def matches(made: Index, query: Query) -> DataFrame:
    """Postings of the query's terms, each with its term; a word under a prefix has the prefix as term."""
    rows = made.postings.where(wanted(F.col("token"), query))
    if made.bucketed:  # parts that can't have a term are not read
        starts = {w[:2] for w in (*query.terms, *([query.prefix] if query.prefix else []))}
        own = sorted({xxhash.xxh64_intdigest(w.encode(), 42) for w in starts})  # as Spark's xxhash64 does
        few = sorted({((h ^ 1 << 63) - (1 << 63)) % BUCKETS for h in own})
        rows = rows.where(F.col("bucket").isin(few) if few else F.lit(False))
    term = F.when(F.col("token").isin(query.terms), F.array(F.col("token"))).otherwise(F.array()) if query.terms else F.array()
    if query.prefix is not None:
        term = F.concat(term, F.when(F.col("token").startswith(query.prefix), F.array(F.lit(query.prefix + "*"))).otherwise(F.array()))
    return rows.select("*", F.explode(term.cast("array<string>")).alias("term"))


def required(query: Query) -> int:
    return len(set(query.terms)) + (query.prefix is not None)


def matching_ids(made: Index, query: Query) -> DataFrame:
    """Documents that have every term in some field."""
    return matches(made, query).groupBy("doc_id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == required(query)).select("doc_id")


def bm25(made: Index, query: Query, weights: dict[str, float]) -> DataFrame:
    """doc_id, score of the documents that have every term."""
    hits = matches(made, query).groupBy("doc_id", "field", "term").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))  # a row for each field and term of the query
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("field"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = hits.join(F.broadcast(made.stats), "field").join(F.broadcast(df), ["field", "term"])
    total = scored.groupBy("doc_id").agg(F.sum(weight * part).alias("score"), F.count_distinct("term").alias("found"))
    return total.where(F.col("found") == required(query)).select("doc_id", "score")


def top(scored: DataFrame, k: int) -> DataFrame:
    """Ties go to the smaller id."""
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """doc_id, score of the k vectors with the largest cosine; ``vectors`` has doc_id and embedding."""
    return top(vectors.select("doc_id", vector.cosine(F.col("embedding"), vector.literal(query)).alias("score")), k)


def tagged(docs: DataFrame, tags: dict[str, Sequence[str]]) -> DataFrame:
    """doc_id of the documents that have one of the values in each of the named columns."""
    rows = docs
    for name, values in tags.items():
        rows = rows.where(F.col(name).isin(list(values)))
    return rows.select("doc_id")


def hydrate(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with their documents' columns; hits without a document are dropped. Hits are few: a top k."""
    return docs.join(F.broadcast(hits), "doc_id")


def union_distinct(first: DataFrame, second: DataFrame) -> DataFrame:
    """doc_id, rank of two ranked lists: the first's order, then what only the second has."""
    a = first.select("doc_id", F.struct(F.lit(0).alias("list"), F.col("rank")).alias("at"))
    b = second.select("doc_id", F.struct(F.lit(1).alias("list"), F.col("rank")).alias("at"))
    return a.union(b).groupBy("doc_id").agg(F.min("at").alias("at"))


def hybrid(made: Index, vectors: DataFrame, query: Query, embedded: list[float], k: int, weights: dict[str, float]) -> DataFrame:
    """Keyword and vector candidates, five for each result, ranked again by cosine only; documents without a vector drop out."""
    words = top(bm25(made, query, weights), WIDE * k).select("doc_id")
    near = nearest(vectors, embedded, WIDE * k).select("doc_id")
    both = words.union(near).distinct()
    return nearest(vectors.join(F.broadcast(both), "doc_id"), embedded, k)


def late_interaction(groups: DataFrame, query: list[list[float]], k: int) -> DataFrame:
    """doc_id, score by the sum over query vectors of the best match; ``groups`` has doc_id and vectors."""
    return top(groups.select("doc_id", vector.max_sim(query, F.col("vectors")).alias("score")), k)


def results(hits: DataFrame, text: str, key: str = "doc_key") -> DataFrame:
    """Hits as they are shown: doc_id or else the key, title, url, snippet, authors, company, published_at and score.

    Columns that are absent or null are empty; authors are parted at commas; an empty date is null.
    """
    say = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) if name in hits.columns else F.lit("")
    names = F.filter(F.transform(F.split(say("authors"), ","), lambda a: F.trim(a)), lambda a: a != "")
    return hits.select(
        F.coalesce(F.nullif(say("doc_id"), F.lit("")), say(key)).alias("doc_id"),
        say("title").alias("title"),
        say("url").alias("url"),
        snippet(say("content"), text).alias("snippet"),
        names.alias("authors"),
        say("company").alias("company"),
        F.nullif(say("published_at"), F.lit("")).alias("published_at"),
        "score",
    )


def search(
    docs: DataFrame,
    vectors: DataFrame,
    text: str,
    embedded: list[float] | None = None,
    mode: str = "hybrid",
    limit: int = 10,
    weights: dict[str, float] | None = None,
    tags: dict[str, Sequence[str]] | None = None,
    made: Index | None = None,
) -> DataFrame:
    """doc_id, title, snippet, score of the best documents; ``docs`` has doc_id, title and content.

    The limit is 1 to 50. A blank query finds nothing; keyword hits are ordered by their score and, as the service
    shows no keyword scores, have score 0 besides ``engine_score``. ``tags`` restricts all candidates to documents with
    one of the values in each named column, before they are ranked; scores stay those among all documents. ``made`` is a
    stored index of the weighted fields.
    """
    if mode not in MODES or not 1 <= limit <= 50:
        raise ValueError("mode is keyword, semantic or hybrid, and the limit 1 to 50")
    weights = weights or {"title": 2.0, "content": 1.0}
    if not text.strip():
        return docs.limit(0).select("doc_id", "title", F.lit("").alias("snippet"), F.lit(0.0).alias("score"), F.lit(0.0).alias("engine_score"))
    if mode != "keyword" and embedded is None:
        raise ValueError("semantic and hybrid search need the query's vector")
    query = parse(text.strip())
    made = made or index(docs, {f: F.col(f) for f in weights}, query)
    only = (lambda rows: rows.join(tagged(docs, tags), "doc_id", "left_semi")) if tags else (lambda rows: rows)
    if mode == "keyword":
        found = top(only(bm25(made, query, weights)), limit)
    elif mode == "semantic":
        found = nearest(only(vectors), embedded, limit)
    else:
        words = top(only(bm25(made, query, weights)), WIDE * limit).select("doc_id")
        both = words.union(nearest(only(vectors), embedded, WIDE * limit).select("doc_id")).distinct()
        found = nearest(vectors.join(F.broadcast(both), "doc_id"), embedded, limit)  # candidates are 2 * WIDE * limit at most
    shown = F.lit(0.0) if mode == "keyword" else F.col("score")
    return hydrate(found, docs).select("doc_id", "title", snippet(F.col("content"), text).alias("snippet"), shown.alias("score"), F.col("score").alias("engine_score"))
