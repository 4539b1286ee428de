import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, keys, urls, vector
from tidemark.functions import text as T


def one(spark, value, *columns, schema="x string"):
    return tuple(spark.createDataFrame([(value,)], schema).select(*columns).first())


@pytest.mark.parametrize(
    ("url", "normal", "canonical"),
    [
        (" HTTP://Ex.com:80/A/b/?q=1#f ", "http://ex.com/A/b?q=1", "http://ex.com:80/A/b"),
        ("https://ex.com:443", "https://ex.com/", "https://ex.com:443"),
        ("https://ex.com:80/", "https://ex.com:80/", "https://ex.com:80"),
        ("ftp://ex.com/a", None, "ftp://ex.com/a"),
        ("not a url", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_urls(spark, url, normal, canonical):
    assert one(spark, url, urls.normalize(F.col("x")), urls.canonical(F.col("x"))) == (normal, canonical)


@pytest.mark.parametrize(
    ("link", "target"),
    [("/a", "https://h.com/a"), ("b", "https://h.com/p/b"), ("?q", "https://h.com/p/c?q"), ("//o.com/x", "https://o.com/x"), ("http://z.com", "http://z.com"), ("#t", None), ("mailto:a@b", None), ("JavaScript:x", None), ("", None)],
)
def test_resolve(spark, link, target):
    assert one(spark, link, urls.resolve(F.lit("https://h.com/p/c?x=1"), F.col("x"))) == (target,)


def test_origin_and_company(spark):
    got = one(spark, "https://u@h.com/", urls.origin(F.col("x")), urls.company(F.lit("https://fb.com/a")), urls.company(F.lit("https://engineering.x.com:8/a")))
    assert got == (None, "Meta", "engineering.x.com:8")


@pytest.mark.parametrize(
    ("text", "start"),
    [
        ("hit here", "hit here"),
        ("a" * 100 + " hit " + "b" * 300, "…"),
        ("no " * 100, "no no"),
        (None, None),
    ],
)
def test_snippet(spark, text, start):
    (got,) = one(spark, text, T.snippet(F.col("x"), "HIT"))
    assert got is None if start is None else got.startswith(start) and len(got) <= 202


def test_topics_and_their_faulty_form(spark):
    said = "We moved from Kafka to apache spark, not sparkling"
    assert one(spark, said, T.topics(F.col("x")), T.topics(F.col("x"), as_written=True)) == (["Kafka", "Spark"], [])


@pytest.mark.parametrize(("a", "b", "f1"), [("a b b", "b b c", 2 / 3), ("", "", 1.0), ("a", "", 0.0), (None, "x", 0.0)])
def test_token_f1(spark, a, b, f1):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(T.token_f1(T.tokens(F.col("a")), T.tokens(F.col("b")))).first()
    assert row[0] == pytest.approx(f1)


@pytest.mark.parametrize(("text", "shape"), [
        ("", "shape:medium_text"),
        ("word " * 21, "shape:medium_text"),
        ("word " * 41, "shape:long_text"),
        ("by " * 81, "shape:long_text"),
        ("by " * 101, "shape:very_long_text"),
        ("Ada Lovelace", "shape:short_text shape:single_name"),
        ("@ada.l", "shape:short_text shape:single_name shape:handle"),
        ("By Ada, 2 days ago.", "shape:short_text phrase:by_prefix shape:multiple_names shape:comma_list shape:relative_date"),
        ("By: Ada and Alan Turing", "shape:short_text phrase:by_prefix phrase:by_colon shape:single_name shape:multiple_names shape:and_last_name"),
        ("Posted May 3, 2024 · 5 min read", "shape:short_text phrase:published shape:multiple_names shape:comma_list shape:absolute_date shape:reading_time shape:date_plus_reading_time"),
        ("thanks to the research team and its director", "shape:short_text phrase:thanks_to shape:multiple_names shape:and_last_name shape:organization shape:name_and_role"),
    ],
)
def test_shapes(spark, text, shape):
    assert " ".join(one(spark, text, T.shape_tokens(F.col("x")))[0]) == shape


def test_shapes_of_links_and_headings(spark):
    made = one(spark, "Ada Lovelace", T.shape_tokens(F.col("x"), F.lit(1), F.lit(True)), T.shape_tokens(F.col("x"), F.lit(3)))
    assert made == (["shape:short_text", "shape:one_link"], ["shape:short_text", "shape:multiple_links", "shape:single_name"])


@pytest.mark.parametrize(
    ("phrase", "at", "want"),
    [
        ("1 month ago", "2024-03-31 10:00:00", "2024-02-29 10:00:00"),
        ("a year ago", "2024-02-29 00:00:00", "2023-02-28 00:00:00"),
        ("two weeks ago", "2024-01-15 00:00:00", "2024-01-01 00:00:00"),
        ("90 minutes ago", "2024-01-01 01:00:00", "2023-12-31 23:30:00"),
        ("soon", "2024-01-01 01:00:00", None),
    ],
)
def test_relative(spark, phrase, at, want):
    (got,) = one(spark, phrase, F.date_format(dates.resolve_relative(F.col("x"), F.lit(at).cast("timestamp")), "yyyy-MM-dd HH:mm:ss"))
    assert got == want


def test_dates(spark):
    assert one(spark, "5 min read", dates.relative_phrase(F.col("x")), dates.reading_time_only(F.col("x"))) == (None, True)
    assert one(spark, "5 min read · 2 days ago", dates.relative_phrase(F.col("x"))) == ("2 days ago",)
    assert one(spark, "3 days ago", dates.published(F.col("x"), F.lit(None).cast("string"), F.lit(None).cast("timestamp"))) == (None,)
    assert one(spark, "May 3, 2020 and 2020-05-03", dates.calendar_date(F.col("x"))) == (dt.date(2020, 5, 3),)
    assert one(spark, "2020-05-03 or 4 May 2020", dates.calendar_date(F.col("x"))) == (None,)
    assert one(spark, "2023-02-31", dates.calendar_date(F.col("x"))) == (None,)
    assert one(spark, "2024-05-01 10:00:00", dates.iso_utc(F.col("x"))) == ("2024-05-01T10:00:00Z",)


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(F.round(vector.cosine(F.col("a"), F.col("b")), 6)).collect()] == [0.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    assert rows.select(vector.max_sim([[1.0, 0.0], [0.0, 1.0]], F.array("a", "b"))).first()[0] == 3.0
    packed = vector.pack(rows.select("a").limit(1), "a", "p").first()
    assert len(packed["p"]) == 8


def test_keys(spark):
    key = lambda version, *rerun: keys.idempotency_key(F.lit("s"), F.lit(version), keys.canonical_json(b=F.lit(1), a=F.lit("x")), F.lit("c"), *rerun)
    x, y, z, forced = one(spark, "", key("1"), key("1", F.lit("")), key("2"), key("1", F.lit("again")))
    assert x == "s:1:" + hashlib.sha256(b'{"configuration_version":"c","input":{"a":"x","b":1},"stage":{"name":"s","version":"1"}}').hexdigest()
    assert forced == f"{x}:force:{hashlib.sha256(b'again').hexdigest()}"
    assert x == y != z
    assert [one(spark, n, keys.retry_delay(F.col("x"), 500, 10_000), schema="x int")[0] for n in (1, 2, 5, 6, 90)] == [500, 1000, 8000, 10000, 10000]
    assert one(spark, "a", keys.jittered(F.lit(1000), F.col("x")))[0] in range(1000)


def test_canonical_json_sorts_every_level_and_needs_finite_numbers(spark):
    rows = spark.createDataFrame([({"b": 1.5, "a": 2.0}, [(1, "x")])], "m map<string, double>, s array<struct<z: int, a: string>>")
    made = keys.canonical_json(rows.schema, s=F.col("s"), m=F.col("m"))
    assert rows.select(made).first()[0] == '{"m":{"a":2.0,"b":1.5},"s":[{"a":"x","z":1}]}'
    bad = spark.createDataFrame([(float("nan"),)], "x double")
    with pytest.raises(Exception, match="not finite"):
        bad.select(keys.canonical_json(bad.schema, x=F.col("x"))).collect()


@pytest.mark.parametrize(
    ("text", "day"),
    [("13/4/2024", "2024-04-13"), ("4/13/2024", "2024-04-13"), ("9/11/2026", None), ("le 9/11/2026 par Ada", "2026-11-09"), ("31/12/49", "2049-12-31"), ("31/12/50", "1950-12-31"), ("31/2/2024", None), ("2024-05-01 and May 1, 2024", "2024-05-01"), ("Sept. 3rd 2020", "2020-09-03")],
)
def test_calendar_dates(spark, text, day):
    assert one(spark, text, dates.calendar_date(F.col("x")).cast("string")) == (day,)


def test_scoring_dates(spark):
    at = F.lit("2024-03-10").cast("date")
    day = lambda text: one(spark, text, dates.scoring_date(F.col("x"), at).cast("string"))[0]
    assert [day(t) for t in ("on 2024-1-5.", "May 3, 2020", "3 may 2020", "2 weeks ago", "1 day ago", "2024-02-30", "no")] == ["2024-01-05", "2020-05-03", "2020-05-03", "2024-02-25", "2024-03-09", None, None]


def test_unpacked_vectors_and_ragged_ones(spark):
    rows = spark.createDataFrame([([1.5, -2.0],), ([],), (None,)], "a array<double>")
    back = vector.unpack(vector.pack(rows, "a", "p"), "p", "b").collect()
    assert [r["b"] for r in back] == [[1.5, -2.0], [], None]
    assert vector.unpack(spark.createDataFrame([(bytearray(b"abc"),)], "p binary"), "p", "b").first()["b"] is None
    ragged = spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "k int, v array<double>")
    with pytest.raises(Exception, match="differ in length"):
        vector.mean_pool(ragged, "k", "v").collect()
