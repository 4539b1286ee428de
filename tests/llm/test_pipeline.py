import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import mixing


def corpus(rng):
    words = {"en": [f"{a}{b}" for a in "the of and ing ow".split() for b in "th er on st ack".split()], "fr": [f"{a}{b}" for a in "le de que oux ée".split() for b in "eau ion ier ez".split()]}
    rows, item = [], " ".join(f"bench{i}" for i in range(40))
    shared = " ".join(f"shared{i}" for i in range(60))
    for i in range(160):
        lang = "en" if i % 3 else "fr"
        text = " ".join("".join(rng.choice(words[lang], 2)) for _ in range(80))
        rows.append([i, text, lang, f"s{i % 4}", len(text)])
    rows[20][1] = rows[10][1]  # an exact copy
    rows[30][1] = rows[31][1].replace(rows[31][1].split()[40], "changed", 1)  # a near copy
    rows[40][1] += " " + item
    rows[50][1] += " " + shared
    rows[60][1] += " " + shared
    rows += [[200, None, "en", "s0", 0], [201, "", "en", "s1", 0], [202, "1234 !!", None, None, 7]]
    return [tuple(r) for r in rows], item, shared


def test_stages(spark, tmp_path):
    rows, item, shared = corpus(np.random.default_rng(1))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, str(tmp_path)))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "mix":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert set(seen["language"]) == set(range(160))
    assert set(seen["near_duplicates"]) == set(range(160)) - {20, 31}
    assert shared in seen["repeats"][50]["text"] and shared not in seen["repeats"][60]["text"]
    assert {i for i in seen["repeats"] if seen["repeats"][i]["text"] != dict((r[0], r[1]) for r in rows)[i]} == {60}
    assert set(seen["decontaminate"]) == set(seen["repeats"]) - {40}
    sizes, want = {}, {}
    for r in seen["decontaminate"].values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    for r in seen["mix"].values():
        want[r["source"]] = want.get(r["source"], 0) + r["taken"]
    assert want == {s: int(t) for s, t in mixing.targets(sizes, (5, 2, 1), 1.5, 2.0).items()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen["mix"])


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_null_and_repeated_ids_in_each_stage(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows, item, _ = corpus(rng)
    rows = [(None if i % 3 == 0 else i % 5, t, la, s, n) for i, t, la, s, n in rows]
    spark.createDataFrame(rows, COLUMNS).withColumns({"size": F.lit(1), "taken": F.lit("x"), "score": F.lit(0)}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, str(tmp_path)))
        seen[name] = docs.collect()
    assert len(seen["language"]) == 160 and len(seen["near_duplicates"]) == 158
    texts = [r["text"] for r in seen["near_duplicates"]]
    assert len(set(texts)) == len(texts) <= len(seen["repeats"])
    assert len(seen["decontaminate"]) == len(seen["repeats"]) - 1 and not any(item in r["text"] for r in seen["decontaminate"])
    sizes = {}
    for r in seen["decontaminate"]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    want = mixing.targets(sizes, (5, 2, 1), 1.5, 2.0)
    for source, target in want.items():
        assert sum(r["taken"] for r in seen["mix"] if r["source"] == source) == int(target)
    assert {(r["doc_id"], r["text"]) for r in seen["mix"]} <= {(r["doc_id"], r["text"]) for r in seen["decontaminate"]}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "an item of some words that is long enough")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
