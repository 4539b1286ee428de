import hashlib

import numpy as np
import pytest
import xxhash

from tidemark.llm import mixing


def brute(rows, share=1.5, repeats=2.0):
    size = lambda t: len([w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t or "").split(" ") if w])
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    wanted = mixing.targets(sizes, (5, 2, 1), share, repeats)
    out = []
    for source, total in sizes.items():
        name = lambda i, t: f"text {np.uint64(xxhash.xxh64_intdigest((t or '').encode(), 42)).astype(np.int64)}" if i is None else i
        own = sorted(((hashlib.md5(f"{name(i, t)}:mix".encode()).hexdigest(), -1 if i is None else i, size(t)) for i, t, s in rows if s == source))
        budget, line = int(wanted[source]), 0
        for _, i, n in own:
            line_taken = 0
            for epoch in range(4):
                line_taken += max(0, min(n, budget - epoch * total - line)) if total else 0
            out.append((source, n, total, wanted[source], line_taken))
            line += n
    return sorted(out, key=str)


def corpus(seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), " ".join(["w"] * int(rng.integers(0, 40))), f"s{int(rng.integers(5)) if rng.random() < 0.5 else 0}") for i in rng.permutation(300)]
    return rows + [(1000, None, "s1"), (1001, "a\tb c", None), (None, "x y", "é"), (1002, "", "only empty"), (5, "dup", "s0"), (5, "dup", "s0")]


@pytest.mark.parametrize(("bucket_rows", "step"), [(10, 3), (1, 1), (20_000, 3)])
def test_against_brute_force(spark, monkeypatch, bucket_rows, step):
    monkeypatch.setattr(mixing, "STEP", step)
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, s, 3) for i, t, s in rows], "doc_id long, text string, source string, size int")
    out = mixing.mix(docs, bucket_rows=bucket_rows).collect()
    got = sorted(((r["source"], r["size"], r["source_size"], r["target"], r["taken"]) for r in out), key=str)
    assert got == brute(rows)
    per = {}
    for s, _, _, t, k in got:
        per[s] = (t, per.get(s, (0, 0))[1] + k)
    assert all(int(t) == k for t, k in per.values())
    assert all(k <= 2 * n for _, n, _, _, k in got)


def test_targets_stop_at_twice_a_source():
    got = mixing.targets({"a": 10, "b": 1000, None: 10}, (5, 2, 1), 1.5, 2.0)
    assert got == {"a": 20.0, None: 20.0, "b": 1490.0}
    assert mixing.targets({}, (5, 2, 1), 1.5, 2.0) == {}


def test_many_null_and_repeated_ids_with_columns_to_keep(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 2 else i % 20, " ".join([f"w{i}"] * int(rng.integers(0, 30))), "ab"[i % 2], i) for i in range(200)] + [(0, "x " * 40_000, "a", 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = mixing.mix(docs, bucket_rows=5, keep=["text", "n_chars"]).collect()
    assert sorted((r["text"], r["n_chars"], r["source"]) for r in out) == sorted((t, n, s) for _, t, s, n in rows)
    per = {}
    for r in out:
        assert r["size"] == len(r["text"].split()) and 0 <= r["taken"] <= 2 * r["size"]
        per[r["source"], int(r["target"])] = per.get((r["source"], int(r["target"])), 0) + r["taken"]
    assert all(t == n for (_, t), n in per.items())


def test_no_rows(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
