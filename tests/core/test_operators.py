import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dataset, evaluation, frontier, retrieval, stage_queue

R, Q = retrieval, stage_queue


def test_query_syntax():
    assert retrieval.parse("Python pr") == retrieval.Query(["python"], "pr")
    assert retrieval.parse("python p") == retrieval.Query(["python"], None)
    assert retrieval.parse("python p", documented=True) == retrieval.Query(["python"], "p")
    assert retrieval.parse("state-of 'the' art ") == retrieval.Query(["state", "of", "the", "art"], None)
    assert retrieval.parse("") == retrieval.Query([], None) == retrieval.parse("x")


@pytest.fixture
def corpus(spark):
    docs = spark.createDataFrame([(1, "Spark joins", "spark spark joins and more"), (2, "Other", "nothing of note"), (3, "Spark", None), (4, "", "sparkling water")], "doc_id long, title string, content string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (4, [0.0, 1.0]), (9, [1.0, 0.0])], "doc_id long, embedding array<double>")
    return docs, vectors


def test_search_modes(corpus):
    docs, vectors = corpus
    ids = lambda *a, **k: [r["doc_id"] for r in retrieval.search(docs, vectors, *a, **k).orderBy(F.desc("engine_score"), "doc_id").collect()]
    assert set(ids("spark ", mode="keyword")) == {1, 3, 4}  # the blank is stripped, so the last word is a prefix
    assert ids("spark joins", mode="keyword") == [1]
    assert ids("  ") == [] and ids("zebra", mode="keyword") == []
    assert ids("x", [1.0, 0.0], "semantic", 2) == [1]  # 9 has no document
    assert ids("joins", [0.0, 1.0], "hybrid", 2) == [4, 2]
    with pytest.raises(ValueError):
        ids("x", mode="other")
    with pytest.raises(ValueError):
        ids("x", mode="keyword", limit=51)


def test_robots(spark):
    text = "User-agent: a\nUser-agent: b\nDisallow: /x\n# note\nUser-agent: *\nDisallow: /\nAllow: /ok$\nCrawl-delay: 0\nRequest-rate: 1/10s"
    rules = frontier.parse_robots(spark.createDataFrame([("h", text), ("e", None)], "host string, text string"))
    paths = spark.createDataFrame([("h", p) for p in ("/x/1", "/ok", "/okay", "/")] + [("e", "/"), ("none", "/")], "host string, path string")
    got = lambda agent: {(r["host"], r["path"]): r["allowed"] for r in frontier.allowed(paths, rules, agent).collect()}
    star, own = got("zz/1"), got("B")
    assert [star["h", p] for p in ("/x/1", "/ok", "/okay", "/")] == [False, True, False, False] and star["e", "/"] and star["none", "/"]
    assert [own["h", p] for p in ("/x/1", "/ok", "/")] == [False, True, True]
    assert [frontier.request_seconds(r) for r in ("3/1m", "7/2h", "0/1", "x")] == [20, 1029, None, None]
    assert rules.where("agent = '*'").select(frontier.spacing(F.col("crawl_delay"), F.col("request_rate"))).first()[0] == 10


def test_sitemap(spark):
    files = spark.createDataFrame([("<?xml version='1.0'?><urlset><url><loc> u1 </loc></url><url><loc>u1</loc></url></urlset>",), ("<html><loc>x</loc></html>",)], "x string")
    assert [r[0] for r in files.select(frontier.sitemap_locs(F.col("x"))).collect()] == [["u1"], []]


def replay(spark, *ops):
    rows = [("r", t, op, kind, "c" if op == "fail" else None, delay, *(token or [None])) for t, op, kind, delay, *token in ops]
    return stage_queue.replay(spark.createDataFrame(rows, stage_queue.EVENT)).first()


def test_queue_transitions(spark):
    done = replay(spark, (0, "enqueue", None, 0), (1, "claim", None, 0), (2, "heartbeat", None, 0), (3, "complete", None, 0), (4, "claim", None, 0))
    assert (done["state"], done["attempts"], done["finished_ms"]) == ("succeeded", 1, 3)
    again = replay(spark, (0, "enqueue", None, 0), (1, "claim", None, 0), (2, "fail", "retryable", 50), (10, "claim", None, 0), (60, "claim", None, 0))
    assert (again["state"], again["attempts"], again["error_code"]) == ("leased", 2, None)
    gone = replay(spark, (0, "enqueue", None, 0), (1, "claim", None, 0), (70_000, "claim", None, 0))
    assert (gone["state"], gone["attempts"]) == ("leased", 2)
    for kind, state in (("permanent", "failed"), ("blocked", "blocked")):
        assert replay(spark, (0, "enqueue", None, 0), (1, "claim", None, 0), (2, "fail", kind, 0))["state"] == state


def test_deferrals_use_up_attempts(spark):
    ops = [(0, "enqueue", None, 0)]
    for i in range(4):
        ops += [(10 * i + 1, "claim", None, 0), (10 * i + 2, "defer", None, 0)]
    end = replay(spark, *ops, (50, "claim", None, 0), (51, "fail", "retryable", 0))
    assert (end["state"], end["attempts"], end["error_code"]) == ("failed", 5, "c")


def test_pairs_must_match(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, g string"), spark.createDataFrame([(1, "x")], "k int, p string")
    assert evaluation.pair_up(a.where("k = 1"), b, "k").count() == 1
    with pytest.raises(Exception, match="unmatched 2"):
        evaluation.pair_up(a, b, "k").collect()


def test_stale_hashes_fail(spark):
    page = spark.createDataFrame([("p", "<html>")], "page_id string, html string")
    good = page.select("page_id", F.sha2("html", 256).alias("html_hash"))
    assert dataset.joined(good, good, page).count() == 1
    with pytest.raises(Exception, match="stale p"):
        dataset.joined(good, good.withColumn("html_hash", F.lit("0")), page).collect()


def test_expand_follows_own_host(spark):
    rows = [(1, "http://a.com/", '<a href="/b">b</a><a href="http://c.com/">c</a>'), (2, "http://a.com/b", '<a href="/d#x">d</a>'), (3, "http://a.com/d", '<a href="/">home</a>')]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r["url"]: r["depth"] for r in frontier.expand(pages, pages.where("page_id = 1").select("url"), 3).collect()}
    assert got == {"http://a.com/": 0, "http://a.com/b": 1, "http://a.com/d": 2}


def test_tokens_fence_off_former_holders(spark):
    ops = [(0, "enqueue", None, 0), (1, "claim", None, 0, "a"), (70_000, "claim", None, 0, "b"), (70_001, "complete", None, 0, "a")]
    assert replay(spark, *ops)["state"] == "leased"
    assert replay(spark, *ops, (70_002, "complete", None, 0, "b"))["state"] == "succeeded"


def test_a_stored_index_answers_like_texts_and_reads_few_buckets(spark, tmp_path):
    rng = random.Random(2)
    words = ["kafka", "kappa", "über", "the", "x1", "stream"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(9))), rng.choice(words)) for i in range(80)] + [(99, None, "")], "doc_id long, content string, title string")
    fields = {"content": F.col("content"), "title": F.col("title")}
    path = f"file://{tmp_path}/index"
    R.store(docs, fields, path)
    stored = R.opened(spark, path)
    R.store(docs.limit(0), fields, path)  # there is one already
    assert {r["documents"] for r in stored.info().collect()} == {81}
    for text in ("kafka the ", "the ka", "über", "x1 x", "nothing", "stream stream "):
        query = R.parse(text)
        scores = [sorted((r["doc_id"], round(r["score"], 9)) for r in R.bm25(made, query, {"content": 1.0, "title": 2.0}).collect()) for made in (stored, R.index(docs, fields), R.index(docs, fields, query))]
        assert scores[0] == scores[1] == scores[2]
    plan = R.matches(stored, R.parse("kafka "))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_search_by_tags_and_results(spark):
    docs = spark.createDataFrame([(1, "a", "xx y", "en"), (2, "b", "xx xx", "fr"), (3, "c", "xx", "fr")], "doc_id long, title string, content string, lang string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "doc_id long, embedding array<double>")
    for mode in R.MODES:
        found = R.search(docs, vectors, "xx ", [1.0, 0.0], mode, tags={"lang": ["fr"]}).collect()
        assert {r["doc_id"] for r in found} == {2, 3}
    shown = R.results(docs.select("title", F.lit("k").alias("doc_key"), F.lit(1.0).alias("score"), F.lit(" Ada, ,Alan ").alias("authors")), "x").first()
    assert (shown["doc_id"], shown["authors"], shown["published_at"], shown["url"]) == ("k", ["Ada", "Alan"], None, "")


def brute_queue(events, lease, most, now):
    """Each run's state by rules, without the transition function."""
    runs = {}
    for e in sorted(events, key=lambda e: (e["run_key"], e["ts_ms"], e["op"])):
        r = runs.setdefault(e["run_key"], {"state": "", "attempts": 0, "lease": None})
        expire(r, e["ts_ms"], most)
        busy = r["state"] in ("leased", "running") and (e["token"] is None or r.get("token") is None or e["token"] == r["token"])
        t = e["ts_ms"]
        if e["op"] == "enqueue" and not r["state"]:
            r |= {"state": "queued", "due": t + e["delay_ms"]}
        elif e["op"] == "claim" and r["state"] == "queued" and r["due"] <= t:
            r |= {"state": "leased", "attempts": r["attempts"] + 1, "lease": t + lease, "token": e["token"]}
        elif e["op"] == "heartbeat" and busy:
            r |= {"state": "running", "lease": t + lease}
        elif e["op"] == "complete" and busy:
            r |= {"state": "succeeded", "lease": None}
        elif e["op"] == "fail" and busy:
            again = e["kind"] == "retryable" and r["attempts"] < most
            r |= {"state": "queued" if again else "blocked" if e["kind"] == "blocked" else "failed", "due": t + e["delay_ms"], "lease": None}
    for r in runs.values():
        expire(r, now, most)
    return {k: (r["state"], r["attempts"]) for k, r in runs.items() if r["state"]}


def expire(r, now, most):
    if r["lease"] is not None and r["lease"] <= now:
        r |= {"state": "queued" if r["attempts"] < most else "failed", "due": r["lease"], "lease": None}


def queue_events(spark, n=400):
    rng = random.Random(5)
    rows = [
        {"run_key": f"r{rng.randrange(12)}", "ts_ms": i * 50, "op": rng.choice(["enqueue", "claim", "claim", "heartbeat", "complete", "fail", "fail"]), "kind": rng.choice(["retryable", "retryable", "permanent", "blocked"]), "error_code": "e", "delay_ms": 100, "token": rng.choice([None, "t"])}
        for i in range(n)
    ]
    return rows, spark.createDataFrame([tuple(r.values()) for r in rows], Q.EVENT)


def test_replay_against_brute_force(spark):
    rows, events = queue_events(spark)
    for now in (0, 400 * 50):
        got = {r["run_key"]: (r["state"], r["attempts"]) for r in Q.replay(events, 1000, 3, now_ms=now).collect()}
        assert got == brute_queue(rows, 1000, 3, now)


def test_streamed_leases_end_without_another_event(spark, tmp_path):
    from tidemark.streaming import stage_queue as S

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, _ = queue_events(spark, 300)
    rows = [r | {"ts_ms": r["ts_ms"] + 1} for r in rows]  # a stream's watermark begins at 0
    rows += [{"run_key": "crashed", "ts_ms": t, "op": op, "kind": None, "error_code": None, "delay_ms": 0, "token": "h"} for t, op in ((10, "enqueue"), (15, "claim"))]
    spark.createDataFrame([tuple(r.values()) for r in rows], Q.EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(Q.EVENT).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = S.runs(stream, 1000, 3).writeStream.outputMode("update").foreachBatch(lambda df, b: df.write.mode("overwrite").parquet(f"{out}/batch={b}")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["run_key"]: (r["state"], r["attempts"]) for r in S.latest(spark.read.schema(S.VERSIONED).parquet(out)).collect()}
    assert got["crashed"] == ("queued", 1)
    assert got == brute_queue(rows, 1000, 3, max(r["ts_ms"] for r in rows))


def test_slots_come_back_and_failures_hold_back(spark):
    origins = spark.createDataFrame([("a", 0, 50, 10, 3, 5), ("b", 0, 0, 10, 0, 5)], "origin string, next_ms long, backoff_ms long, interval_ms long, in_flight long, max_in_flight long")
    ended = spark.createDataFrame([("a", None), ("a", 20), ("b", 0)], "origin string, backoff_ms long")
    out = {r["origin"]: (r["backoff_ms"], r["in_flight"]) for r in Q.release(origins, ended, F.lit(100).cast("long")).collect()}
    assert out == {"a": (120, 1), "b": (0, 0)}


def test_sequence_ids_have_no_gaps(spark):
    rows = spark.range(500).selectExpr("id AS k")
    for digits in (1, 3):
        got = sorted((r["sequence_id"], r["k"]) for r in dataset.sequence_ids(rows, "k", digits).collect())
        assert got == list(enumerate(sorted(range(500), key=lambda k: hashlib.sha256(str(k).encode()).hexdigest()), 1))


def test_tag_vocabulary_and_stale_overrides(spark):
    nodes = spark.createDataFrame([("P", "div"), ("a", "p"), ("html", None)], "tag string, parent_tag string")
    assert [tuple(r) for r in dataset.tag_vocabulary(nodes).collect()] == [("a", 2), ("div", 3), ("html", 4), ("p", 5)]
    over = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, html_hash string")
    assert [r["k"] for r in dataset.stale(over, spark.createDataFrame([(1, "x"), (2, "other")], "k int, html_hash string"), "k").collect()] == [2]


def test_catalogued_seeds_and_sitemaps(spark):
    catalog = spark.createDataFrame([("s", "S", "a.example", ["/blog"], [r"^/blog/[^/]+$"], None, ["/sitemap.xml"])], frontier.CATALOG)
    pages = spark.createDataFrame([("https://a.example/blog/",), ("https://a.example/blog/x",), ("https://b.example/",), ("x",), (None,)], "url string")
    assert [(r["kind"], r["error"]) for r in frontier.seeds(pages, catalog).collect()] == [("listing", None), ("article", None), *[("reject", f"not in the catalog of sources: {h}") for h in ("b.example", "<missing-host>", "<missing-host>")]]
    index = lambda *u: "<sitemapindex>" + "".join(f"<loc>{x}</loc>" for x in u) + "</sitemapindex>"
    leaf = lambda *u: "<urlset>" + "".join(f"<loc>{x}</loc>" for x in u) + "</urlset>"
    files = spark.createDataFrame([("r", index("m", "n", "r", "gone")), ("m", leaf("http://x/1", "http://x/2")), ("n", index("o")), ("o", leaf("http://x/2", "http://x/3/"))], "url string, xml string")
    walk = lambda **k: [r["url"] for r in frontier.sitemap_walk(files, ["r"], **k).orderBy("place").collect()]
    assert walk() == ["http://x/1", "http://x/2", "http://x/3"] and walk(limit=2) == ["http://x/1", "http://x/2"] and walk(most=3) == ["http://x/1", "http://x/2"]
    assert frontier.sitemap_walk(files, []).count() == 0


def test_robots_know_agents_by_their_product(spark):
    rules = frontier.parse_robots(spark.createDataFrame([("h", "User-agent: tide\nDisallow: /a*b$\nAllow: /a\nUser-agent: mozilla\nDisallow: /\n")], "host string, text string"))
    paths = spark.createDataFrame([("h", "/axb"), ("h", "/ab/c"), ("h", "/z")], "host string, path string")
    got = [r["allowed"] for r in frontier.allowed(paths, rules, "TideBot/2.0 (Mozilla)").orderBy("path").collect()]
    assert got == [True, False, True]


def test_providers():
    from tidemark.operators import providers

    assert providers.provider("Dummy") is providers.PROVIDERS["dummy"]
    for ask in (lambda: providers.provider("none"), lambda: providers.run_stage("none", None)):
        with pytest.raises(ValueError, match="none"):
            ask()


def test_split_counts_and_scores_by_scope(spark):
    rows = spark.createDataFrame([("train", 1), ("test", 0)], "split string, label int")
    assert evaluation.split_counts(rows, "split", "label", {"train": 1}).count() == 2
    with pytest.raises(Exception, match="wrong size"):
        evaluation.split_counts(rows, "split", "label", {"train": 2}).collect()
    made = spark.createDataFrame([("train", "t", "x", 1.0, True), ("test", "t", None, 0.0, False), ("test", "t", "", 1.0, True)], "split string, field string, gold string, f1 double, exact boolean")
    got = {r["scope"]: (r["n"], r["accuracy"], r["specificity"]) for r in evaluation.benchmark_scores(made).collect()}
    assert got == {"all": (3, 2 / 3, 0.5), "nontrain": (2, 0.5, 0.5), "test": (2, 0.5, 0.5)}


def test_storing_an_index_shuffles_texts_and_not_their_postings(spark, tmp_path):
    rng = random.Random(3)
    texts = [(i % 90, " ".join(f"w{rng.randrange(300)}" for _ in range(200)), "t t u") for i in range(100)] + [(None, "a b", ""), (None, "a c", None), (7, "_", "Z")]
    docs = spark.createDataFrame(texts, "doc_id long, content string, title string")
    fields = {"content": F.col("content"), "title": F.col("title")}
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()

    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = moved()
    R.store(docs, fields, f"file://{tmp_path}/index")
    assert sum(n for k, n in moved().items() if k not in before) < 5 * len(texts)
    stored, made = R.opened(spark, f"file://{tmp_path}/index"), R.index(docs, fields)
    for name, columns in (("postings", ("token", "field", "doc_id", "tf", "length")), ("stats", ("field", "n", "mean"))):
        a, b = (getattr(x, name).select(*columns) for x in (stored, made))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.dtypes == b.dtypes
    unique = docs.where("doc_id > 20 and doc_id < 80")
    R.store(unique, fields, f"file://{tmp_path}/unique")
    assert sorted(map(str, R.opened(spark, f"file://{tmp_path}/unique").postings.drop("bucket").collect())) == sorted(map(str, R.index(unique, fields).postings.select("token", "field", "doc_id", "length", "tf").collect()))


def test_the_stream_sends_timers_only_if_a_lease_changes():
    from pyspark.sql import Row

    from tidemark.streaming.stage_queue import Runs

    class Handle:
        def __init__(self):
            self.value, self.calls = None, []
            self.getValueState = lambda name, schema: self
            self.get, self.exists = lambda: self.value, lambda: self.value is not None
            self.registerTimer, self.deleteTimer = lambda t: self.calls.append(("set", t)), lambda t: self.calls.append(("delete", t))
            self.listTimers = lambda: self.calls.append("list") or []

        def update(self, value):
            self.value = value

    def send(*events):
        handle.calls.clear()
        rows = [Row(op=op, ts_ms=ts, kind=None, error_code=None, delay_ms=None, token=None) for ts, op in events]
        return [(r.state, r.version) for r in runs.handleInputRows(("k",), iter(rows), None)], list(handle.calls)

    handle, runs = Handle(), Runs(60_000, 5)
    runs.init(handle)
    assert send((5, "heartbeat")) == ([], [])
    assert send((11, "claim"), (10, "enqueue")) == ([("leased", 2)], [("set", 60_011)])
    assert send((12, "enqueue")) == ([("leased", 3)], [])
    assert send((20, "heartbeat")) == ([("running", 4)], [("delete", 60_011), ("set", 60_020)])
    assert send((30, "complete")) == ([("succeeded", 5)], [("delete", 60_020)])
