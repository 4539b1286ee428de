"""Dates, keys, the stage queue, data sets and evaluation over the star schema, events and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, keys
from tidemark.functions import text as T
from tidemark.operators import dataset, evaluation
from tidemark.operators import stage_queue as Q
from tidemark.sources.tables import scratch, table

NOW = 1_000


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))


def relative_date_resolve(spark: SparkSession, d: str) -> DataFrame:
    unit = F.element_at(F.array(*(F.lit(u) for u in ("minute", "hour", "day", "week", "month", "year"))), (F.col("event_id") % 6 + 1).cast("int"))
    said = F.concat(F.lit("Posted "), F.when(F.col("event_id") % 4 == 0, "two").otherwise((F.col("user_id") % 13 + 1).cast("string")), F.lit(" "), unit, F.lit("s ago"))
    rows = events(spark, d).select("event_id", F.col("ts").cast("timestamp").alias("at"), said.alias("said"))
    return rows.select("event_id", dates.relative_phrase(F.col("said")).alias("phrase"), F.date_format(dates.resolve_relative(F.col("said"), F.col("at")), "yyyy-MM-dd HH:mm:ss").alias("at"))


def month_clamp(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), F.concat((F.col("o_orderkey") % 24 + 1).cast("string"), F.lit(" months ago")).alias("said"))
    return rows.select("o_orderkey", F.date_format(dates.resolve_relative(F.col("said"), F.col("at")), "yyyy-MM-dd").alias("day"))


def reading_time_reject(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("event_id") % 3 == 0, "5 min read").when(F.col("event_id") % 3 == 1, "5 min read · 2 days ago").otherwise("ten minutes reading now")
    rows = events(spark, d).select(said.alias("said"))
    return rows.groupBy("said", dates.reading_time_only(F.col("said")).alias("only"), dates.relative_phrase(F.col("said")).alias("phrase")).agg(F.count("*").alias("n"))


def published_at_precedence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    rows = events(spark, d).select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"), F.when(k == 0, "2024-05-01").when(k == 1, "3 days ago").alias("absolute"), F.when(k == 2, "2 hours ago").when(k == 0, "1 day ago").alias("relative"))
    return rows.select("event_id", dates.published(F.col("absolute"), F.col("relative"), F.col("at")).alias("published"))


def dated_texts(spark: SparkSession, d: str) -> DataFrame:
    """Orders' dates as texts in many ways."""
    day, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 9
    ways = ["'Published' MMMM d, yyyy", "d MMM yyyy", "yyyy/MM/dd", "M/d/yyyy", "d/M/yyyy", "'le' dd/MM/yyyy 'par Ada'", "d/M/yy", "MMM. d'th' yyyy"]
    said = F.lit("2024-02-30 or 2024-03-01 and May 3, 2020")
    for i, way in enumerate(ways):
        said = F.when(k == i, F.date_format(day, way)).otherwise(said)
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate", said.alias("said"))


def calendar_dates(spark: SparkSession, d: str) -> DataFrame:
    return dated_texts(spark, d).select("o_orderkey", F.date_format(dates.calendar_date(F.col("said")), "yyyy-MM-dd").alias("day"))


def scoring_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = dated_texts(spark, d).withColumn("said", F.when(F.col("o_orderkey") % 9 == 8, F.concat(F.col("o_orderkey") % 20, F.lit(" weeks  ago"))).otherwise(F.col("said")))
    return rows.select("o_orderkey", F.date_format(dates.scoring_date(F.col("said"), F.col("o_orderdate")), "yyyy-MM-dd").alias("day"))


def byline_prefix(spark: SparkSession, d: str) -> DataFrame:
    start = F.element_at(F.array(*(F.lit(x) for x in ("By ", "Written by: ", "authors:", "AUTHORED BY - ", "", "Bypass "))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", T.without_byline_prefix(F.concat(start, F.col("c_name"))).alias("names"))


def benchmark_report(spark: SparkSession, d: str) -> DataFrame:
    """Scores by scope and field over the labels, as if they were a benchmark's pages."""
    j = judged(spark, d).withColumn("k", F.col("doc_id") % 10)
    rows = j.select(
        F.when(F.col("k") < 6, "train").when(F.col("k") < 8, "validation").otherwise("test").alias("split"),
        F.col("lang").alias("field"),
        F.when(F.col("doc_id") % 4 > 0, "x").alias("gold"),
        ((F.col("doc_id") % 11) / 10.0).alias("f1"),
        (F.col("doc_id") % 11 == 10).alias("exact"),
    )
    columns = ("accuracy", "mean_f1", "exact", "specificity")
    return evaluation.benchmark_scores(rows).select("scope", "field", "n", *(F.round(c, 6).alias(c) for c in columns))


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.latency_summary(events(spark, d), "event_type", "value").withColumn("mean", F.round("mean", 6))


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "region").select(F.when(F.col("r_regionkey") < 3, "train").otherwise("test").alias("split"), (F.col("r_regionkey") % 2).alias("label"))
    return evaluation.split_counts(rows, "split", "label", {"train": 3, "test": 2})


def idempotency_key(spark: SparkSession, d: str) -> DataFrame:
    payload = keys.canonical_json(status=F.col("o_orderstatus"), customer=F.col("o_custkey"), order=F.col("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", keys.idempotency_key(F.lit("fetch_raw"), F.lit("v1"), payload, F.lit("cfg.2")).alias("key"))


def rerun_key(spark: SparkSession, d: str) -> DataFrame:
    payload = keys.canonical_json(id=F.col("c_custkey"), nothing=F.lit(None).cast("string"))
    rerun = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", keys.idempotency_key(F.lit("index"), F.lit("2"), payload, F.lit("1"), rerun).alias("key"), keys.valid_digest(F.sha2(payload, 256)).alias("valid"))


def enqueue_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return Q.first_of(events(spark, d), F.concat_ws(":", "user_id", "event_type")).where("created").select("event_id")


def retry_backoff_cap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("attempt"), keys.retry_delay(F.col("l_linenumber"), 500, 10_000).alias("delay_ms")).agg(F.count("*").alias("n"))


OPS = {"signup": "enqueue", "view": "claim", "click": "heartbeat", "error": "fail", "purchase": "complete"}


def as_queue_events(rows: DataFrame) -> DataFrame:
    """Events as a queue's: five runs for each user."""
    op = F.element_at(F.create_map(*(F.lit(x) for kv in OPS.items() for x in kv)), F.col("event_type"))
    kind = F.when(F.col("event_id") % 7 == 0, "permanent").when(F.col("event_id") % 11 == 0, "blocked").otherwise("retryable")
    return rows.select(
        F.concat_ws(":", "user_id", F.col("event_id") % 5).alias("run_key"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        op.alias("op"),
        kind.alias("kind"),
        F.concat(F.lit("e"), F.col("event_id") % 3).alias("error_code"),
        F.lit(1_000).cast("long").alias("delay_ms"),
        F.when(F.col("event_id") % 3 == 0, "t").alias("token"),
    )


def queue_replay(spark: SparkSession, d: str) -> DataFrame:
    return Q.replay(as_queue_events(table(spark, d, "events")))


def stage_queue_stream(spark: SparkSession, d: str) -> DataFrame:
    """The replay as a stream over all events, written as a table; the last row of each run, leases that ran out taken back."""
    import uuid

    from tidemark.streaming import stage_queue as S

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    raw = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    path = f"{scratch(spark)}/runs-{uuid.uuid4().hex}"
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")  # noqa: E731 - a batch that is tried again replaces itself
    query = S.runs(as_queue_events(raw)).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return S.latest(spark.read.schema(S.VERSIONED).parquet(path))


def lease_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Heartbeats whose run's next event comes after the lease has run out."""
    w = Window.partitionBy("user_id").orderBy("ts_ms", "event_id")
    gap = F.lead("ts_ms").over(w) - F.col("ts_ms")
    return events(spark, d).withColumn("gap", gap).where(F.col("event_type") == "click").groupBy("user_id").agg(F.sum((F.coalesce("gap", F.lit(1 << 40)) >= Q.LEASE_MS).cast("int")).alias("expired"))


def polite_claims(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select(F.col("user_id").alias("origin"), F.col("event_id").alias("id"), "ts_ms")
    return Q.claims(rows, 3_600_000).select("id", "at_ms")


def order_runs(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "leased").otherwise("queued")
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("run_key"), state.alias("state"), (F.col("o_orderkey") % 2000).alias("due_ms"))


def queue_state_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.counts(order_runs(spark, d), F.lit(NOW))


def queue_snapshot_sample(spark: SparkSession, d: str) -> DataFrame:
    return Q.snapshot(order_runs(spark, d), F.lit(NOW), 40).select("run_key", "state", "rank")


def fetch_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    runs = order_runs(spark, d).withColumn("origin", (F.col("run_key").cast("long") % 40).cast("string"))
    k = F.col("n_nationkey") * 1
    origins = table(spark, d, "nation").select(
        k.cast("string").alias("origin"), (k * 60).cast("long").alias("next_ms"), F.when(k % 7 == 3, 5000).otherwise(0).cast("long").alias("backoff_ms"), (k % 3 * 100).cast("long").alias("interval_ms"), (k % 4).cast("long").alias("in_flight"), F.lit(5).cast("long").alias("max_in_flight")
    )
    return runs, origins


def fetch_grants(spark: SparkSession, d: str) -> DataFrame:
    return Q.grant(*fetch_tables(spark, d), F.lit(NOW), 60)


def fetch_origins(spark: SparkSession, d: str) -> DataFrame:
    runs, origins = fetch_tables(spark, d)
    return Q.reserve(origins, Q.grant(runs, origins, F.lit(NOW), 60), F.lit(NOW).cast("long")).select("origin", "next_ms", "in_flight")


def release_origins(spark: SparkSession, d: str) -> DataFrame:
    """A third of the orders' runs end; some failures hold their origins back."""
    runs, origins = fetch_tables(spark, d)
    k = F.col("run_key").cast("long")
    ended = runs.where(k % 3 == 0).select("origin", F.when(k % 5 == 0, k % 700).alias("backoff_ms"))
    return Q.release(origins.withColumn("in_flight", F.col("in_flight") * 100), ended, F.lit(NOW).cast("long")).select("origin", "backoff_ms", "in_flight")


def admitted(spark: SparkSession, d: str) -> DataFrame:
    """Events' users as items: each once, not those seen; those whose enqueuing failed are not seen afterwards."""
    e = table(spark, d, "events").select(F.col("user_id").alias("url"))
    new, after = Q.admit(e, e.where("url % 4 = 0").distinct(), e.where("url % 5 = 0"))
    return new.select(F.lit("new").alias("what"), "url").union(after.select(F.lit("seen"), "url")).groupBy("what").agg(F.count("*").alias("n"), F.sum("url").alias("total"))


def cleared_stage(spark: SparkSession, d: str) -> DataFrame:
    runs = order_runs(spark, d).withColumn("run_key", F.concat(F.when(F.col("due_ms") % 2 == 0, "fetch").otherwise("index"), F.lit(":"), "run_key"))
    return Q.counts(Q.cleared(runs, "fetch"), F.lit(NOW))


def sequence_ids(spark: SparkSession, d: str) -> DataFrame:
    return dataset.sequence_ids(table(spark, d, "customer").select("c_custkey"), "c_custkey")


def requeue_failed(spark: SparkSession, d: str) -> DataFrame:
    return Q.counts(Q.requeue(order_runs(spark, d), ("failed",), F.lit(NOW)), F.lit(NOW))


def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.histogram(events(spark, d), "value")


def p95_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.nearest_rank(events(spark, d), "event_type", "value")


def p95_floor_index(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.floor_index(events(spark, d), "event_type", "value")


def turns(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("a"))
    n = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return t.join(n, ["conv_id", "turn"])


def token_f1(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.overlaps(turns(spark, d), ["conv_id", "turn"], "a", "b").select("conv_id", "turn", F.round(evaluation.f1(), 6).alias("f1"))


def word_error_multiset(spark: SparkSession, d: str) -> DataFrame:
    found = evaluation.overlaps(turns(spark, d), ["conv_id", "turn"], "a", "b")
    return found.select("conv_id", "turn", (F.col("gold_n") - F.col("common")).alias("missing"), (F.col("predicted_n") - F.col("common")).alias("unwanted"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")


def accuracy_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.accuracy(judged(spark, d), [["lang"], ["source", "lang"], []], F.col("quality") != F.col("toxic"), ["source", "lang"])
    return out.withColumn("accuracy", F.round("accuracy", 6))


def accuracy_present(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy over all rows and over those that have the field."""
    found = evaluation.accuracy(judged(spark, d), [["lang"], []], F.col("quality") != F.col("toxic"), ["lang"], F.col("doc_id") % 3 > 0)
    return found.select("lang", "n", "present_n", F.round("accuracy", 6).alias("accuracy"), F.round("present_accuracy", 6).alias("present_accuracy"))


def missing_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.missing_scores(judged(spark, d), "lang", F.when(F.col("quality") == 1, 1), F.when(F.col("toxic") == 0, 1))
    return out.select("lang", *(F.round(c, 6).alias(c) for c in ("missing_precision", "missing_recall")))


def site_split_hash(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split_sites(table(spark, d, "documents"), "source")


def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    return dataset.round_robin(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", ["es", "en", "fr"], 50).select("doc_id", "lang", "turn")


def one_per_site_sample(spark: SparkSession, d: str) -> DataFrame:
    return dataset.one_per_group_first(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 30).select("doc_id", "source", "later")


def vocab_top_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("t"))
    return dataset.vocabulary(words, "t", ("de", "zzz", "the"), 64)


def token_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("t"))
    return rows.select("conv_id", "turn", F.concat_ws(",", dataset.encode(F.col("t"), {"the": 2, "of": 3, "and": 4}, 12).cast("array<string>")).alias("ids"))


def standardized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.round(dataset.standardize(F.col("c_acctbal"), 4500.0, 500.0, 6.0), 6).alias("x"))


def normalizer_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", F.lit(3.0).alias("same"))
    return dataset.normalizer(rows, ["l_quantity", "l_extendedprice", "l_discount", "same"]).select("column", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def nearest_anchor(spark: SparkSession, d: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts_ms", "event_id"))
    rows = events(spark, d).withColumn("at", at).withColumn("is_anchor", F.col("event_type") == "purchase")
    return dataset.nearest_anchor(rows, "user_id", "at", "is_anchor").select("event_id", "anchor")


def argmax_with_missing(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "event_id", (F.floor("value") / 10).alias("s"))
    return evaluation.argmax_with_missing(rows, "user_id", "event_id", F.col("s"), 9.0).select("user_id", "chosen", F.round("share", 6).alias("share"))


def text_shape_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", T.shape_tokens(F.col("text"))).alias("shape"))


def name_shape_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.person_name(F.concat(F.lit("Ada "), F.regexp_replace("c_name", "[^A-Za-z]", ""))).alias("person"), T.person_name(F.col("c_name")).alias("raw"), T.split_names(F.concat(F.lit("ogSite_nameX-"), F.col("c_mktsegment"))).alias("words"))


def coalesce_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 3 != 0").select("c_custkey", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("summary"))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "").otherwise("new title").alias("title"), F.when(F.col("c_custkey") % 8 == 0, "").otherwise("new").alias("summary"))
    return dataset.upsert(old, new, "c_custkey", ["title"], ["summary"])


def margin_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select((F.col("o_totalprice") % 100 / 100).alias("gain"), (F.col("o_orderkey") % 3 == 0).alias("fixed_ok"), (F.col("o_orderkey") % 5 < 2).alias("kept_ok"))
    return evaluation.choose_margin(rows, [0.0, 0.25, 0.5, 0.75, 1.0])


def plan_differences(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    return dataset.symmetric_difference(n.where("k < 20"), n.where("k >= 5"))


_T = "SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS a FROM conversations"
_TURNS = f"t AS ({_T}), p AS (SELECT x.conv_id, x.turn, x.a, y.a AS b FROM t x JOIN t y ON x.conv_id = y.conv_id AND y.turn - 1 = x.turn), o AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda u: u = w)), len(list_filter(b, lambda u: u = w))))) AS common FROM p)"
_MS = "(epoch_us(ts) // 1000)"
_LABELLED = "j AS (SELECT l.*, d.lang, d.source FROM labels l JOIN documents d USING (doc_id))"
_RUNS = "r AS (SELECT o_orderkey::VARCHAR AS run_key, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'leased' ELSE 'queued' END AS state, o_orderkey % 2000 AS due_ms FROM orders)"
_GRANTS = f"""{_RUNS}, o AS (SELECT n_nationkey::VARCHAR AS origin, n_nationkey * 60 AS next_ms, CASE WHEN n_nationkey % 7 = 3 THEN 5000 ELSE 0 END AS backoff_ms, n_nationkey % 3 * 100 AS interval_ms, n_nationkey % 4 AS in_flight FROM nation),
 s AS (SELECT origin, CASE WHEN interval_ms > 0 THEN least(1, 5 - in_flight) ELSE 5 - in_flight END AS slots FROM o WHERE greatest(next_ms, backoff_ms) <= 1000),
 t AS (SELECT run_key, (run_key::BIGINT % 40)::VARCHAR AS origin, due_ms FROM r WHERE state = 'queued' AND due_ms <= 1000),
 k AS (SELECT t.*, slots, row_number() OVER (PARTITION BY origin ORDER BY due_ms, run_key) AS turn FROM t JOIN s USING (origin)),
 g AS (SELECT run_key, origin FROM (SELECT *, row_number() OVER (ORDER BY due_ms, run_key) AS r FROM k WHERE turn <= slots) WHERE r <= 60 - (SELECT sum(in_flight) FROM o))"""

def _shapes() -> str:
    """Phrases by the fixed patterns; a text with more than 500 characters or 80 words has none."""
    on = lambda pattern: f"regexp_matches(x, '(?i){pattern}')"
    phrases = {
        "phrase:by_prefix": on(r"^\s*(?:by\b|written\s+by\b|author\s*:?)"),
        "phrase:by_colon": on(r"^\s*by\s*:"),
        "phrase:written_by": on(r"\bwritten\s+by\b"),
        "phrase:article_written_by": on(r"^\s*(?:this\s+)?article\s+(?:was\s+)?written\s+by\b"),
        "phrase:author_label": on(r"^\s*authors?\s*:"),
        "phrase:acknowledgements": on(r"\backnowledg(?:e)?ments?\b"),
        "phrase:contributors": on(r"\bcontributors?|contributions?\b"),
        "phrase:thanks_to": on(r"\bthanks\s+to\b"),
        "phrase:published": on(r"\b(?:publish(?:ed)?|posted)\b"),
        "phrase:updated": on(r"\b(?:updated?|modified)\b"),
        "shape:single_name": f"(w BETWEEN 1 AND 8 AND 2 * len(list_filter(ws, lambda y: regexp_matches(y, '^\\p{{Lu}}'))) >= w AND NOT {_DATE_SQL}) OR regexp_matches(trim(x), '^@[\\w.-]+$')",
        "shape:multiple_names": on(r"(?:\s(?:and|und|et|y)\s|[,;&/·•])"),
        "shape:comma_list": "contains(x, ',')",
        "shape:and_last_name": r"regexp_matches(x, '(?i)(?:\band\b|&)\s+[\p{L}\p{N}_.''’-]+(?:\s+[\p{L}\p{N}_.''’-]+){0,4}[.!]?\s*$')",
        "shape:handle": on(r"^\s*@[\w.-]+\s*$"),
        "shape:organization": on(r"\bteam\b"),
        "shape:name_and_role": on(r"\b(?:engineer|researcher|scientist|member|staff|director|lead|manager|editor)\b"),
        "shape:absolute_date": _DATE_SQL,
        "shape:relative_date": on(r"\b(?:an?|one|two|three|four|five|six|seven|eight|nine|ten|\d+)\s+(?:minute|hour|day|week|month|year)s?\s+ago\b"),
        "shape:reading_time": on(r"\b(?:an?|one|two|three|four|five|six|seven|eight|nine|ten|\d+)\s*(?:min(?:ute)?s?|hours?)\s+(?:read|reading)\b"),
    }
    cases = ", ".join(f"CASE WHEN w <= 80 AND length(x) <= 500 AND ({sql}) THEN '{name}' END" for name, sql in phrases.items())
    return rf"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS x, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda y: y <> '') AS ws FROM conversations), d AS (SELECT *, len(ws) AS w FROM c)
    SELECT conv_id, turn, concat_ws(' ', CASE WHEN w BETWEEN 1 AND 20 THEN 'shape:short_text' WHEN w <= 40 THEN 'shape:medium_text' WHEN w <= 100 THEN 'shape:long_text' ELSE 'shape:very_long_text' END, {cases}) AS shape FROM d"""


_DATE_SQL = r"regexp_matches(x, '(?i)(?:\b(?:19|20)\d{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12]\d|3[01])\b)|(?:\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+(?:19|20)\d{2}\b)')"
SPECS = {
    "relative_date_resolve": (
        relative_date_resolve,
        """WITH e AS (SELECT event_id, ts, (['minute','hour','day','week','month','year'])[event_id % 6 + 1] AS unit, CASE WHEN event_id % 4 = 0 THEN 2 ELSE user_id % 13 + 1 END AS n FROM events)
        SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'two' ELSE n::VARCHAR END || ' ' || unit || 's ago' AS phrase,
          strftime(ts - CASE unit WHEN 'minute' THEN to_minutes(n) WHEN 'hour' THEN to_hours(n) WHEN 'day' THEN to_days(n::INT) WHEN 'week' THEN to_days((7 * n)::INT) WHEN 'month' THEN to_months(n::INT) ELSE to_years(n::INT) END, '%Y-%m-%d %H:%M:%S') AS at FROM e""",
    ),
    "month_clamp": (month_clamp, "SELECT o_orderkey, strftime(o_orderdate - to_months((o_orderkey % 24 + 1)::INT), '%Y-%m-%d') AS day FROM orders"),
    "reading_time_reject": (
        reading_time_reject,
        "SELECT (['5 min read', '5 min read · 2 days ago', 'ten minutes reading now'])[event_id % 3 + 1] AS said, event_id % 3 = 0 AS only, CASE WHEN event_id % 3 = 1 THEN '2 days ago' END AS phrase, count(*) AS n FROM events GROUP BY ALL",
    ),
    "published_at_precedence": (
        published_at_precedence,
        "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '2024-05-01' WHEN 1 THEN strftime(ts - INTERVAL 3 DAY, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') END AS published FROM events",
    ),
    "calendar_dates": (
        calendar_dates,
        """WITH o AS (SELECT o_orderkey, o_orderdate AS t, o_orderkey % 9 AS k, day(o_orderdate) AS dd FROM orders)
        SELECT o_orderkey, CASE WHEN k IN (3, 4) AND dd <= 12 THEN NULL WHEN k = 6 AND dd <= 12 THEN NULL WHEN k = 8 THEN NULL ELSE strftime(t, '%Y-%m-%d') END AS day FROM o""",
    ),
    "scoring_dates": (
        scoring_dates,
        """SELECT o_orderkey, CASE WHEN o_orderkey % 9 IN (0, 1, 7) THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 9 = 8 THEN strftime(o_orderdate - to_days((o_orderkey % 20 * 7)::INT), '%Y-%m-%d') END AS day FROM orders""",
    ),
    "byline_prefix": (byline_prefix, "SELECT c_custkey, CASE WHEN c_custkey % 6 = 5 THEN 'pass ' ELSE '' END || lower(c_name) AS names FROM customer"),
    "benchmark_report": (
        benchmark_report,
        """WITH j AS (SELECT l.doc_id AS d, lang AS field FROM labels l JOIN documents USING (doc_id)), r AS (SELECT *, CASE WHEN d % 10 < 6 THEN 'train' WHEN d % 10 < 8 THEN 'validation' ELSE 'test' END AS split, d % 11 / 10 AS f1 FROM j),
        s AS (SELECT 'all' AS scope, * FROM r UNION ALL SELECT 'nontrain', * FROM r WHERE split <> 'train' UNION ALL SELECT split, * FROM r WHERE split <> 'train')
        SELECT scope, field, count(*) AS n, round(avg((f1 >= 0.9)::INT), 6) AS accuracy, round(avg(f1), 6) AS mean_f1, round(avg((d % 11 = 10)::INT), 6) AS exact, round(avg((f1 = 1)::INT) FILTER (d % 4 = 0), 6) AS specificity FROM s GROUP BY scope, field""",
    ),
    "latency_summary": (latency_summary, "SELECT event_type, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type"),
    "split_counts": (split_counts, "SELECT CASE WHEN r_regionkey < 3 THEN 'train' ELSE 'test' END AS split, r_regionkey % 2 AS label, count(*) AS n FROM region GROUP BY ALL"),
    "idempotency_key": (idempotency_key, """SELECT o_orderkey, 'fetch_raw:v1:' || sha256('{"configuration_version":"cfg.2","input":{"customer":' || o_custkey || ',"order":' || o_orderkey || ',"status":"' || o_orderstatus || '"},"stage":{"name":"fetch_raw","version":"v1"}}') AS key FROM orders"""),
    "rerun_key": (rerun_key, """SELECT c_custkey, 'index:2:' || sha256('{"configuration_version":"1","input":{"id":' || c_custkey || ',"nothing":null},"stage":{"name":"index","version":"2"}}') || CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN ':force:' || sha256(c_custkey::VARCHAR) ELSE '' END AS key, true AS valid FROM customer"""),
    "enqueue_dedupe": (enqueue_dedupe, "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"),
    "retry_backoff_cap": (retry_backoff_cap, "SELECT l_linenumber::INT AS attempt, least(10000, 500 * 2 ** (l_linenumber - 1))::BIGINT AS delay_ms, count(*) AS n FROM lineitem GROUP BY ALL"),
    "queue_replay": (queue_replay, None),
    "stage_queue_stream": (stage_queue_stream, None),
    "lease_expiry": (
        lease_expiry,
        f"WITH e AS (SELECT *, lead({_MS}) OVER (PARTITION BY user_id ORDER BY {_MS}, event_id) - {_MS} AS gap FROM events) SELECT user_id, sum((coalesce(gap, 1099511627776) >= 60000)::INT)::BIGINT AS expired FROM e WHERE event_type = 'click' GROUP BY user_id",
    ),
    "polite_claims": (
        polite_claims,
        f"""WITH RECURSIVE e AS (SELECT user_id, event_id AS id, {_MS} AS t, row_number() OVER (PARTITION BY user_id ORDER BY {_MS}, event_id) AS k FROM events),
        c AS (SELECT user_id, id, t AS at_ms, k FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.id, greatest(e.t, c.at_ms + 3600000), e.k FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1)
        SELECT id, at_ms FROM c""",
    ),
    "queue_state_counts": (queue_state_counts, f"WITH {_RUNS} SELECT CASE WHEN state = 'queued' AND due_ms > 1000 THEN 'delayed' WHEN state = 'queued' THEN 'ready' ELSE state END AS state, count(*) AS n FROM r GROUP BY 1"),
    "queue_snapshot_sample": (
        queue_snapshot_sample,
        f"WITH {_RUNS}, k AS (SELECT *, CASE state WHEN 'leased' THEN 0 WHEN 'queued' THEN CASE WHEN due_ms <= 1000 THEN 1 ELSE 2 END ELSE 3 END AS rank FROM r ORDER BY rank, due_ms, run_key LIMIT 40) SELECT run_key, state, rank FROM k",
    ),
    "fetch_grants": (fetch_grants, f"WITH {_GRANTS} SELECT run_key, origin FROM g"),
    "fetch_origins": (
        fetch_origins,
        f"WITH {_GRANTS}, n AS (SELECT origin, count(*) AS k FROM g GROUP BY origin) SELECT o.origin, CASE WHEN k > 0 THEN 1000 + interval_ms ELSE next_ms END::BIGINT AS next_ms, (in_flight + coalesce(k, 0))::BIGINT AS in_flight FROM o LEFT JOIN n USING (origin)",
    ),
    "release_origins": (
        release_origins,
        f"""WITH {_GRANTS}, e AS (SELECT (run_key::BIGINT % 40)::VARCHAR AS origin, count(*) AS n, max(CASE WHEN run_key::BIGINT % 5 = 0 THEN run_key::BIGINT % 700 ELSE 0 END) AS wait FROM r WHERE run_key::BIGINT % 3 = 0 GROUP BY 1)
        SELECT o.origin, CASE WHEN coalesce(wait, 0) > 0 THEN greatest(backoff_ms, 1000 + wait) ELSE backoff_ms END::BIGINT AS backoff_ms, greatest(0, in_flight * 100 - coalesce(n, 0))::BIGINT AS in_flight FROM o LEFT JOIN e USING (origin)""",
    ),
    "admitted": (
        admitted,
        """WITH u AS (SELECT DISTINCT user_id AS url FROM events) SELECT 'new' AS what, count(*) AS n, sum(url)::BIGINT AS total FROM u WHERE url % 4 <> 0
        UNION ALL SELECT 'seen', count(*), sum(url)::BIGINT FROM u WHERE url % 4 = 0 OR url % 5 <> 0""",
    ),
    "cleared_stage": (cleared_stage, f"WITH {_RUNS} SELECT CASE WHEN state = 'queued' AND due_ms > 1000 THEN 'delayed' WHEN state = 'queued' THEN 'ready' ELSE state END AS state, count(*) AS n FROM r WHERE due_ms % 2 <> 0 GROUP BY 1"),
    "sequence_ids": (sequence_ids, "SELECT c_custkey, row_number() OVER (ORDER BY sha256(c_custkey::VARCHAR)) AS sequence_id FROM customer"),
    "requeue_failed": (requeue_failed, f"WITH {_RUNS} SELECT CASE WHEN state = 'queued' AND due_ms > 1000 THEN 'delayed' WHEN state IN ('queued', 'failed') THEN 'ready' ELSE state END AS state, count(*) AS n FROM r GROUP BY 1"),
    "latency_histogram": (
        latency_histogram,
        "SELECT b::VARCHAR AS le, (SELECT count(*) FROM events WHERE value <= b) AS n FROM (SELECT unnest([5,10,20,30,40,50,75,100,200,400,800]) AS b) UNION ALL SELECT '+Inf', count(value) FROM events",
    ),
    "p95_nearest_rank": (p95_nearest_rank, "SELECT event_type, list_sort(list(value))[ceil(count(value) * 0.95)::INT] AS p FROM events GROUP BY event_type"),
    "p95_floor_index": (p95_floor_index, "SELECT event_type, list_sort(list(value))[floor(0.95 * (count(value) - 1))::INT + 1] AS p FROM events GROUP BY event_type"),
    "token_f1": (token_f1, f"WITH {_TURNS} SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * common / (len(a) + len(b)) END::DOUBLE, 6) AS f1 FROM o"),
    "word_error_multiset": (word_error_multiset, f"WITH {_TURNS} SELECT conv_id, turn, (len(a) - coalesce(common, 0))::BIGINT AS missing, (len(b) - coalesce(common, 0))::BIGINT AS unwanted FROM o"),
    "accuracy_grouping_sets": (
        accuracy_grouping_sets,
        f"WITH {_LABELLED} SELECT source, lang, count(*) AS n, sum((quality <> toxic)::INT)::BIGINT AS correct, round(avg((quality <> toxic)::INT), 6) AS accuracy FROM j GROUP BY GROUPING SETS ((lang), (source, lang), ())",
    ),
    "accuracy_present": (
        accuracy_present,
        f"WITH {_LABELLED} SELECT lang, count(*) AS n, count(*) FILTER (doc_id % 3 > 0) AS present_n, round(avg((quality <> toxic)::INT), 6) AS accuracy, round(avg((quality <> toxic)::INT) FILTER (doc_id % 3 > 0), 6) AS present_accuracy FROM j GROUP BY GROUPING SETS ((lang), ())",
    ),
    "missing_precision_recall": (
        missing_precision_recall,
        f"WITH {_LABELLED}, s AS (SELECT lang, sum((quality <> 1 AND toxic <> 0)::INT) AS hit, sum((toxic <> 0)::INT) AS said, sum((quality <> 1)::INT) AS truth FROM j GROUP BY lang) SELECT lang, round(hit / greatest(1, said), 6) AS missing_precision, round(hit / greatest(1, truth), 6) AS missing_recall FROM s",
    ),
    "site_split_hash": (
        site_split_hash,
        "WITH s AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY sha256(source)) AS rank, greatest(1, round_even((SELECT count(*) FROM s) * 0.15, 0))::INT AS k FROM s) SELECT source, CASE WHEN rank <= k THEN 'test' WHEN rank <= 2 * k THEN 'validation' ELSE 'train' END AS split FROM r",
    ),
    "round_robin_sample": (
        round_robin_sample,
        "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents WHERE lang IN ('es', 'en', 'fr')) SELECT doc_id, lang, turn FROM r ORDER BY turn, list_position(['es', 'en', 'fr'], lang) LIMIT 50",
    ),
    "one_per_site_sample": (one_per_site_sample, "WITH r AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) > 1)::INT AS later FROM documents) SELECT doc_id, source, later FROM r ORDER BY later, doc_id LIMIT 30"),
    "vocab_top_tokens": (
        vocab_top_tokens,
        "WITH c AS (SELECT token, count(*) AS n, list_position(['de', 'zzz', 'the'], token) AS p FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS token FROM documents) GROUP BY token), k AS (SELECT token, n, row_number() OVER (ORDER BY p IS NULL, p, n DESC, encode(token)) AS r FROM c) SELECT token, (r + 1)::INT AS id, n FROM k WHERE r <= 64",
    ),
    "token_ids": (
        token_ids,
        f"WITH t AS ({_T}) SELECT conv_id, turn, array_to_string(list_transform(range(1, 13), lambda i: CASE WHEN i > len(a) THEN 0 WHEN a[i] = 'the' THEN 2 WHEN a[i] = 'of' THEN 3 WHEN a[i] = 'and' THEN 4 ELSE 1 END), ',') AS ids FROM t",
    ),
    "standardized": (standardized, "SELECT c_custkey, round(greatest(-6.0, least(6.0, (c_acctbal - 4500.0) / 500.0))::DOUBLE, 6) AS x FROM customer"),
    "normalizer_stats": (
        normalizer_stats,
        "SELECT 'l_quantity' AS \"column\", round(avg(l_quantity), 4) AS mean, round(stddev_pop(l_quantity), 4) AS std FROM lineitem UNION ALL SELECT 'l_extendedprice', round(avg(l_extendedprice), 4), round(stddev_pop(l_extendedprice), 4) FROM lineitem UNION ALL SELECT 'l_discount', round(avg(l_discount), 4), round(stddev_pop(l_discount), 4) FROM lineitem UNION ALL SELECT 'same', 3.0, 1.0",
    ),
    "nearest_anchor": (
        nearest_anchor,
        f"""WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY {_MS}, event_id) AS at, event_type = 'purchase' AS a FROM events)
        SELECT e.event_id, arg_min(x.at, abs(x.at - e.at) * 1000000 + x.at)::INT AS anchor FROM e LEFT JOIN e x ON x.user_id = e.user_id AND x.a GROUP BY e.event_id""",
    ),
    "argmax_with_missing": (
        argmax_with_missing,
        "WITH s AS (SELECT user_id, event_id, floor(value) / 10 AS s FROM events), b AS (SELECT user_id, max(s) AS m, sum(exp(s - 9.0)) + 1 AS total FROM s GROUP BY user_id) SELECT user_id, (SELECT min(event_id) FROM s WHERE s.user_id = b.user_id AND s.s = b.m AND m >= 9.0) AS chosen, round(exp(greatest(m, 9.0) - 9.0) / total, 6) AS share FROM b",
    ),
    "text_shape_tokens": (text_shape_tokens, _shapes()),
    "name_shape_flags": (
        name_shape_flags,
        r"SELECT c_custkey, regexp_matches('Ada ' || regexp_replace(c_name, '[^A-Za-z]', '', 'g'), '^\p{Lu}[\p{L}''’.-]*(\s+\p{Lu}[\p{L}''’.-]*){1,4}$') AS person, regexp_matches(c_name, '^\p{Lu}[\p{L}''’.-]*(\s+\p{Lu}[\p{L}''’.-]*){1,4}$') AS raw, 'og site name x ' || lower(c_mktsegment) AS words FROM customer",
    ),
    "coalesce_upsert": (
        coalesce_upsert,
        """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 4 <> 0 THEN 'new title' WHEN c_custkey % 3 <> 0 THEN c_name END AS title,
          CASE WHEN c_custkey % 8 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS summary FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0""",
    ),
    "margin_sweep": (
        margin_sweep,
        "SELECT m::DOUBLE AS margin, sum(CASE WHEN o_totalprice % 100 / 100 > m THEN o_orderkey % 3 = 0 ELSE o_orderkey % 5 < 2 END::INT)::BIGINT AS correct, sum((o_totalprice % 100 / 100 > m)::INT)::BIGINT AS changed FROM orders, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS m) GROUP BY m ORDER BY correct DESC, changed, m LIMIT 1",
    ),
    "plan_differences": (plan_differences, "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 5 THEN 'left' ELSE 'right' END AS side FROM nation WHERE n_nationkey < 5 OR n_nationkey >= 20"),
}
