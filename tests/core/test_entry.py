import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stream_agrees_with_replay(spark):
    from tidemark.operators import stage_queue
    from tidemark.plans import work_queries

    events = work_queries.as_queue_events(spark.read.parquet(f"{SF}/events.parquet"))
    end = events.agg({"ts_ms": "max"}).first()[0]
    rows = [sorted(tuple(r) for r in q.collect()) for q in (stage_queue.replay(events, now_ms=end), __spark_entry__.queries()["stage_queue_stream"](spark, SF))]
    assert str(rows[0]) == str(rows[1])
