import os
import zlib

import pytest

from tidemark.llm import common, oracles, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_against_sql(spark, duck, name):
    rows = queries.QUERIES[name](spark, SF)
    want = duck.sql(oracles.ORACLES[name])
    columns = sorted(rows.columns)
    assert columns == sorted(want.columns)
    clean = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    got = sorted((clean(r[c] for c in columns) for r in rows.collect()), key=str)
    assert got == sorted((clean(r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=str)


CONTRACTS = {
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op5_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op6_suffix": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op7_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_urls": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op9_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_merkle": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
}


@pytest.mark.parametrize("name", list(CONTRACTS))
def test_columns_and_rows(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    assert CONTRACTS[name].items() <= dict(rows.dtypes).items()
    table = "pages" if name in ("op4_html", "op8_urls") else "documents"
    assert rows.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_a_null_id_is_never_learned_from(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,), (3,)], "doc_id long")
    found = {r["doc_id"]: r["h"] for r in rows.select("doc_id", queries.held_out(4, 2).alias("h")).collect()}
    assert found == {None: True, **{i: zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 2, 3)}}


def test_commonest_rows_by_a_threshold(spark):
    rows = spark.createDataFrame([(f"w{i}", i // 3) for i in range(30)], "w string, n long")
    found = lambda most: {r["w"] for r in common.commonest(rows, "n", most).collect()}
    assert found(100) == {f"w{i}" for i in range(30)} and found(0) == found(2) == set()
    assert found(3) == found(5) == {"w27", "w28", "w29"} and len(found(6)) == 6
