import hashlib

import numpy as np
import pytest

from tidemark.llm import suffix


def brute(rows, least=50):
    texts = [(i if i is not None else suffix.LAST, (t or "").encode()) for i, t in rows]
    where = {}
    for i, t in texts:
        for q in range(len(t) - least + 1):
            w = t[q : q + least]
            where[w] = min(where.get(w, i), i)
    out = []
    for (i, t), (raw, _) in zip(texts, rows, strict=True):
        gone = np.zeros(len(t), bool)
        for q in range(len(t) - least + 1):
            if where[t[q : q + least]] < i:
                gone[q : q + least] = True
        n_spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((raw, len(t), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, least=50):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")
    return sorted(
        ((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.repeats(docs, least).collect()), key=str
    )


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "é", "größe", *(f"w{i}x" for i in range(300))]
    say = lambda k: " ".join(rng.choice(words, k))
    passages = [say(int(rng.integers(6, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [say(int(rng.integers(1, 80)))]
        if rng.random() < 0.6:
            parts += [passages[int(rng.integers(6))], say(int(rng.integers(0, 20)))]
        if rows and rng.random() < 0.3:
            t = rows[int(rng.integers(len(rows)))][1]
            a = int(rng.integers(0, max(1, len(t))))
            parts.append(t[a : a + int(rng.integers(40, 120))])
        rows.append((int(rng.integers(-5, 1000)), " ".join(parts)))
    rows += [(2000, None), (2001, ""), (2002, "ab" * 300), (2003, "ab" * 200), (2004, "x" * 49), (2005, "x" * 49), (2006, "x" * 50), (2007, "x" * 500)]
    rows += [(rows[0][0], rows[0][1]), (rows[3][0], rows[5][1]), (None, rows[1][1]), (None, rows[2][1] + say(30))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_frequent_keys_are_cut_into_windows(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_DOCS", 2)
    monkeypatch.setattr(suffix, "BLOCK", 200)
    rows = corpus(3, 80)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("least", [30, 200])
def test_other_lengths(spark, least):
    rows = corpus(5) + [(3000 + i, "abcdefgh" * 60 + str(i)) for i in range(3)]
    assert run(spark, rows, least) == brute(rows, least)
    with pytest.raises(ValueError, match="least"):
        suffix.repeats(spark.createDataFrame(rows, "doc_id long, text string"), 24)


def test_many_null_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    passage = "a passage that several of the documents have, longer than fifty bytes"
    say = lambda: " ".join(f"w{int(x)}" for x in rng.integers(0, 10**6, 12))
    rows = [(5, passage)] + [(None, f"{say()} {passage if i % 3 else say()} {say()}") for i in range(2000)] + [(7, f"{say()} {passage}") for _ in range(400)]
    assert run(spark, rows) == brute(rows)


def test_several_buckets_a_partition_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "FULL_BYTES", 500)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 10)
    monkeypatch.setattr(suffix, "TEXT_BYTES", 300)
    monkeypatch.setattr(suffix, "SUFFIXES", 50)
    rows = corpus(7)
    assert run(spark, rows) == brute(rows)


def test_clashing_columns_and_repeated_rows(spark):
    text = "x" + "a passage that both of the documents have, longer than fifty bytes"
    docs = spark.createDataFrame([(1, text, 5, "l"), (2, text, 5, "l"), (2, text, 5, "l")], "doc_id long, text string, spans int, dest string")
    out = suffix.repeats(docs.withColumnRenamed("dest", "lang"), keep=["lang"]).collect()
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in out) == [(1, text, "l"), (2, "", "l"), (2, "", "l")]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_previous_factors_against_pairs():
    rng = np.random.default_rng(4)
    least = 12
    text = rng.integers(97, 99, (80, least + 4)).astype(np.uint8)
    text[40:] = text[:40]
    doc = rng.integers(0, 9, 80)
    flat = np.zeros((80, 32), np.uint8)
    flat[:, :least] = text[:, :least]
    words = np.stack([flat[:, k : k + 8].copy().view(">u8")[:, 0].astype(np.uint64) for k in (0, 8)], 1)
    got = suffix.previous_factors(words, doc, least) >= least
    want = [any(doc[j] < doc[i] and (text[i, :least] == text[j, :least]).all() for j in range(80)) for i in range(80)]
    assert got.tolist() == want
