import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, quality, toxicity
from tidemark.llm.common import fold, rescale, sample, saved

SYLLABLES = {"aa": "ka lo mi nu".split(), "bb": "tre zon wix quol".split(), "cc": "ka zon pe ru".split()}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], int(rng.integers(1, 4)))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    return [(i, lang, say(rng, lang, int(rng.integers(3, 60)))) for i, lang in enumerate(rng.choice(list(SYLLABLES), 400).tolist())]


def test_language_held_out(spark, texts):
    docs = spark.createDataFrame([(i, t, la, "x") for i, la, t in texts] + [(900, None, "aa", "x"), (901, "12 -- !", None, "x"), (902, "", "bb", "x")], "doc_id long, text string, lang string, score string")
    held = fold(F.col("doc_id"), 4) == 2
    out = language.identify(docs, language.fit(docs.where(~held)), held.alias("held_out")).collect()
    assert len(out) == 403
    truth = {i: la for i, la, _ in texts}
    judged = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in judged]) > 0.95
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if r["doc_id"] >= 900)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_unseen_words_fall_back_to_their_parts(spark, texts):
    docs = spark.createDataFrame([(i, t, la) for i, la, t in texts], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert "quolquolquolquol" not in model.words and model.predict("quolquolquolquol")[0] == "bb"
    assert model.predict("日本") [0] in model.languages  # letters, but none that training has seen


def test_counts_of_words_take_little_of_the_driver():
    rng = np.random.default_rng(3)
    names, languages = [f"w{i}" for i in range(20_000)], ["de", "en", "es", "fr"]
    held = [sorted(rng.choice(languages, int(rng.integers(1, 5)), replace=False).tolist()) for _ in names]
    by = [[{"lang": la, "n": 300 + i % 7 + k} for k, la in enumerate(some)] for i, some in enumerate(held)]
    kind = pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))
    found = pa.table({"word": names, "by": pa.chunked_array([pa.array(by[:9], kind), pa.array(by[9:], kind)])})
    tracemalloc.start()
    try:
        words, scores = language._scores(found, "word", languages)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    counts = np.array([[next((x["n"] for x in some if x["lang"] == la), 0) for la in languages] for some in by])
    logs = np.log((counts + 0.2) / (counts.sum(axis=0) + 0.2 * len(names)))
    assert words == {w: i for i, w in enumerate(names)} and np.allclose(scores, logs - logs.mean(axis=1, keepdims=True), atol=1e-6)
    assert peak < 400 * len(names)  # bytes; with a dict for each word and language about twice that and more


def test_language_without_training_rows(spark):
    none = spark.createDataFrame([(1, "ka lo", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language.identify(none, language.fit(none)).collect()] == [(1, "und", 0.0)]
    assert language.identify(none.limit(0), language.fit(none)).count() == 0


def brute_segments(weights):
    """Maximal segments by their recursive definition."""
    if not len(weights) or max(weights) <= 0:
        return []
    best, at = 0.0, None
    for i in range(len(weights)):
        total = 0.0
        for j in range(i, len(weights)):
            total += weights[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    i, j = at
    return [*brute_segments(weights[:i]), (i, j, best), *[(a + j, b + j, s) for a, b, s in brute_segments(weights[j:])]]


def test_segments_are_all_maximal_ones():
    rng = np.random.default_rng(2)
    for _ in range(200):
        weights = rng.normal(-0.2, 1, int(rng.integers(0, 25)))
        got, want = toxicity.segments(weights), brute_segments(weights.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxicity_held_out(spark, texts):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i, _, t in texts:
        toxic = int(rng.random() < 0.2)
        words = t.split()
        if toxic:
            at = int(rng.integers(len(words)))
            words[at:at] = [f"zorg{s}" for s in rng.choice(["", "ka", "lo", "mi"], 4)]
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.where(fold(F.col("doc_id"), 5) != 0))
    out = {r["doc_id"]: r for r in toxicity.score(docs, model, (fold(F.col("doc_id"), 5) == 0).alias("held_out")).collect()}
    assert len(out) == 402 and all(0 <= r["score"] <= 1 for r in out.values()) and out[900]["score"] == out[901]["score"] < 0.5
    judged = [(out[i]["score"] >= 0.5, y) for i, y in labels if out[i]["held_out"]]
    assert np.mean([p == bool(y) for p, y in judged]) > 0.95
    spans = [out[i]["passages"] for i, y in labels if y]
    assert all(t.split()[p["start"] : p["end"]] for (_, t), found in zip([r for r, (_, y) in zip(rows, labels, strict=True) if y], spans, strict=True) for p in found)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 <= toxicity.score(docs, model).first()["score"] < 0.5


QUALITY = "doc_id long, text string, lang string, source string, n_chars long, t string"


def quality_scores(docs, marks):
    seen = saved(quality.features(docs))
    return quality.score(seen, quality.fit(seen, marks))


def test_quality_by_two_views(spark, texts):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i, _, t in texts:
        good = int(rng.random() < 0.7)
        text = t + "." if good else " | ".join(t.split()[:2] * 20)
        rows.append((i, text, "en", "a" if rng.random() < (0.9 if good else 0.1) else "b", len(text), "x"))
        if rng.random() < 0.5:
            labels.append((i, good))
    extra = [(900, None, None, None, None, "x"), (901, "", "en", "a", 0, "x"), (None, "ka lo.", "en", "a", 6, "x"), (902, "word " * 50_000, "en", "b", 250_000, "x"), rows[0]]
    docs = spark.createDataFrame([*rows, *extra], QUALITY)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality_scores(docs, marks.where(fold(F.col("doc_id"), 5) != 0)).collect()
    assert len(out) == 405 and all(0 <= r[c] <= 1 for r in out for c in ("score", "text_score", "meta_score"))
    assert len({r["score"] for r in out if r["doc_id"] == rows[0][0]}) == 1
    found = {r["doc_id"]: r for r in out}
    test = [(found[i]["keep"], bool(y)) for i, y in labels if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in test]) > 0.9
    assert quality_scores(docs.limit(0), marks).count() == 0


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1, "x"), (2, "b", "en", "s", 1, "x")], QUALITY)
    assert len({r["score"] for r in quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}) == 1


def test_the_metadata_view_never_sees_texts(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 7, "x"), (2, "other | text http://x", "en", "s", 7, "x")], QUALITY)
    assert len({str(sorted(r["m"].items())) for r in quality.features(docs).collect()}) == 1


def test_thresholds_and_gifts_against_brute_force(spark):
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 50, 20)), "en", f"s{i % 7}", i, "x") for i in range(400)], QUALITY)
    seen = saved(quality.features(docs))
    model = quality.QualityModel(rng.normal(size=16 + quality.TEXT_BUCKETS), rng.normal(size=16 + quality.META_BUCKETS))
    rows = seen.collect()
    raw = [[sum(v * w[k] for k, v in r[c].items()) for r in rows] for c, w in (("t", model.text_weights), ("m", model.meta_weights))]
    cuts, parts = quality.thresholds(seen, model, 0.6)
    width = 16.0 / quality.BINS
    for v in (0, 1):
        x = np.sort(np.clip(raw[v], -8, 8 - 1e-9))
        assert x[int(np.ceil(0.05 * 0.4 * 400)) - 1] <= cuts[v][0] + 1e-6 and cuts[v][0] - x[int(np.ceil(0.05 * 0.4 * 400)) - 1] <= width + 1e-6
        assert cuts[v][1] - 1e-6 <= x[-int(np.ceil(0.05 * 0.6 * 400))] <= cuts[v][1] + width + 1e-6
    assert parts[0] == (1.0, 1.0)
    known = spark.createDataFrame([(i,) for i in range(0, 400, 2)], "doc_id long")
    given = quality.gifts(seen, known, model, 0.6, 0).to_pylist()
    want = sorted((r["doc_id"], v, y) for v in (0, 1) for r, s in zip(rows, raw[v], strict=True) for y, sure in ((0, s < cuts[v][0]), (1, s >= cuts[v][1])) if sure and r["doc_id"] % 2)
    assert sorted((g["doc_id"], g["view"], g["label"]) for g in given) == want


def test_samples_weigh_what_they_stand_for(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    few, share = sample(rows, "y", 500)
    counts = {r["y"]: r["count"] for r in few.groupBy("y").count().collect()}
    assert share == {1: 0.5, 0: 500 / 3000} and all(400 < n < 600 for n in counts.values())
    rng = np.random.default_rng(5)
    x = rng.normal(size=20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(2 * x - 3)))).astype(float)
    kept = (y > 0) | (rng.random(20_000) < 0.1)
    a, b = rescale(x[kept], y[kept], np.where(y > 0, 1.0, 10.0)[kept])
    assert abs(a - 2) < 0.3 and abs(b + 3) < 0.3


def brute_language(model, text):
    total = np.zeros(len(model.languages))
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    for w in words:
        if w in model.words:
            total += model.word_scores[model.words[w]]
            continue
        for order in language.ORDERS:
            known = [model.gram_scores[model.grams[g]] for g in (f" {w} "[i : i + order] for i in range(len(w) + 3 - order)) if g in model.grams]
            if known:
                total += np.mean(known, axis=0)
                break
    best = int(total.argmax())
    return model.languages[best], 1 / sum(np.exp((total - total[best]) / len(words) ** 0.5))


def test_language_against_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", 7)
    monkeypatch.setattr(language, "REMEMBERED", 20)
    model = language.fit(spark.createDataFrame([(i, t, la) for i, la, t in texts], "doc_id long, text string, lang string"))
    rng = np.random.default_rng(7)
    for text in [*(t for _, _, t in texts[:60]), *(say(rng, la, 40) for la in SYLLABLES), "kalo" * 500 + " x", "trezon" * 100 + "9" + "Ka"]:
        lang, score = model.predict(text)
        want = brute_language(model, text)
        assert lang == want[0] and abs(score - want[1]) < 1e-4


def test_language_ties_repeats_and_long_words(spark):
    docs = spark.createDataFrame([(1, "ka ka", "bb", "x"), (2, "ka ka", "aa", "x"), (3, "lo", "aa", "x"), (4, "mu", "bb", "x")], "doc_id long, text string, lang string, lang_pred string")
    model = language.fit(docs)
    assert model.predict("ka")[0] == "aa"  # the first by name
    assert model.predict("lo" * 100_000)[0] == "aa"
    out = language.identify(docs.union(docs), model).collect()
    assert len(out) == 8 and len({(r["doc_id"], r["lang_pred"]) for r in out}) == 4


def brute_evidence(model, text):
    tokens = __import__("re").findall(r"\w+", text.lower())
    weights = [max((model.weights.words.get(t, 0.0), *(model.weights.stems.get(t[:n], 0.0) for n in toxicity.STEMS if len(t) >= n)), key=abs) - toxicity.DRIFT for t in tokens]
    best = max((sum(weights[i:j]) for i in range(len(weights)) for j in range(i + 1, len(weights) + 1)), default=0.0)
    return model.rate * max(0.0, best) - model.log_k - np.log(max(1, len(tokens)))


def test_toxicity_scores_against_brute_force(spark, texts):
    rows = [(i, ("zorg zorgka " if i % 5 == 0 else "") + t) for i, _, t in texts]
    docs = spark.createDataFrame([(i, t, 1) for i, t in [*rows, rows[0], (None, "ka zorg"), (990, "ka " * 60_000)]], "doc_id long, text string, score int")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    for _, t in rows[:80]:
        assert abs(model.evidence(*model.passages(t)) - brute_evidence(model, t)) < 1e-6
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows) + 3 and len({r["score"] for r in out if r["doc_id"] == rows[0][0]}) == 1
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_rescale_is_monotone_and_calibrated():
    rng = np.random.default_rng(5)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    a, b = rescale(x, y)
    assert abs(a - 2) < 0.3 and abs(b + 1) < 0.2
    assert rescale(np.r_[-1e3, 1e3], np.array([0.0, 1.0]))[0] > 0
