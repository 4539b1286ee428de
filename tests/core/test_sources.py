import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.functions import text as T
from tidemark.operators import dataset, stage_queue
from tidemark.sources import tables


def test_texts_and_blobs(spark, tmp_path):
    (tmp_path / "a.html").write_text("one\ntwo é")
    (tmp_path / "b.html").write_text("")
    texts = tables.whole_texts(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "([a-z]+)\\.html$", 1))
    found = tables.read_or_empty(spark.createDataFrame([("a",), ("b",), ("missing",)], "path string"), texts)
    assert {r["path"]: r["text"] for r in found.collect()} == {"a": "one\ntwo é", "b": "", "missing": ""}
    assert sorted(r["length"] for r in tables.blobs(spark, str(tmp_path)).collect()) == [10]  # a scan skips empty files


@pytest.mark.parametrize("kind", ["parquet", "json", "orc"])
def test_write_and_read(spark, tmp_path, kind):
    rows = spark.createDataFrame([(1, "a", ["x"]), (2, None, [])], "k int, s string, l array<string>")
    tables.write(rows, str(tmp_path / kind), kind, partition_by=("k",))
    tables.write(rows.where("k = 1"), str(tmp_path / kind), kind, partition_by=("k",))
    back = spark.read.schema(rows.schema).format(kind).load(str(tmp_path / kind))
    assert [(r["k"], r["s"], r["l"]) for r in back.collect()] == [(1, "a", ["x"])]
    with pytest.raises(ValueError):
        tables.write(rows, str(tmp_path / "no"), mode="merge")


def test_manifest_and_annotations(spark, tmp_path):
    lines = [{"page_id": "p", "html_hash": "0" * 64, "is_article": True}, {"page_id": "q", "html_hash": "short"}, {"html_hash": None}]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, lines)))
    got = {r["page_id"]: r["errors"] for r in tables.manifest(spark, str(tmp_path / "m.json")).collect()}
    assert got == {"p": [], "q": ["html_hash"], None: ["page_id", "html_hash"]}
    (tmp_path / "a.json").write_text(json.dumps({"page_id": "p", "labels": {"title": 3, "date": None}}))
    assert tables.annotations(spark, str(tmp_path / "a.json")).first()["labels"] == {"title": 3, "date": None}
    assert tables.empty(spark, "a int").count() == 0


def test_names_coverage_and_overrides(spark):
    rows = spark.createDataFrame([("index_v2",), ("Bad",), (None,), ("",)], "n string")
    assert [r[0] for r in rows.select(keys.valid_name(F.col("n"))).collect()] == [True, False, False, False]
    words = spark.createDataFrame([(["ada", "b"], ["ada"]), ([], ["x"])], "a array<string>, b array<string>")
    assert [r[0] for r in words.select(T.coverage(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]
    assert [r["n"] for r in dataset.unused(rows.where("n != ''"), rows.where("n = 'Bad'"), "n").collect()] == ["index_v2"]


def test_configure_origin(spark):
    origins = spark.createDataFrame([("a", 50, 0, 10, 1, 2), ("b", 50, 0, 10, 0, 2)], "origin string, next_ms long, backoff_ms long, interval_ms long, in_flight long, max_in_flight long")
    limits = spark.createDataFrame([("a", 500, 7, True)], "origin string, interval_ms long, max_in_flight long, reserve_from_now boolean")
    got = {r["origin"]: (r["next_ms"], r["interval_ms"], r["max_in_flight"]) for r in stage_queue.configure(origins, limits, F.lit(100).cast("long")).collect()}
    assert got == {"a": (600, 500, 7), "b": (50, 10, 2)}
