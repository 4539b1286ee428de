import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    prints = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]
        runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] > label[j]:
                    label[i] = label[j]
                    changed = True
    ids = [min(rows[j][0] for j in range(len(rows)) if label[j] == label[i]) for i in range(len(rows))]
    return sorted((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, ids, strict=True))


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    out = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    return sorted((r[0], r[1], r[2]) for r in out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        base = list(rng.choice(words, 150))
        rows.append((len(rows), " ".join(base)))
        for k in range(i % 4):
            copy = list(base)
            copy[int(rng.integers(150))] = f"x{k}"
            rows.append((len(rows), "\n".join(copy)))
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "Én"), (504, "one TWO"), (505, "ONE two"), (506, rows[0][1]), (507, " ".join(words * 40))]
    assert run(spark, rows) == brute(rows)


def test_meeting_finds_each_pair_within_three_bits():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    close = [base]
    for k in range(1, 6):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for _ in base], np.uint64)
        close.append(base ^ flips)
    prints = np.unique(np.concatenate(close))
    for bits in (0, 3, 8):
        rows, prefix = simhash.prefixes(prints, bits)
        a, b = [], []
        for p in np.unique(prefix):
            own = rows[prefix == p]
            x, y = simhash.meet(prints[own], int(p), bits)
            a.append(own[x])
            b.append(own[y])
        found = simhash.forest(len(prints), np.concatenate(a), np.concatenate(b))
        i, j = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None]) <= 3)
        assert (found == simhash.forest(len(prints), i, j)).all()


def test_empty_table_repeated_rows_and_clashing_columns(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(7, "a b c d", 1, 2), (7, "a b c d", 3, 4), (None, "a b c d", 5, 6)], "doc_id long, text string, fp long, component_id long")
    out = simhash.near_duplicates(docs)
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == ["7", "7", "None"]
    assert out.where(F.col("component_id") == 7).count() == 3


def test_several_fingerprints_find_copies_with_edits(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(2000)]
    rows, group = [], {}
    for i in range(30):
        base = list(rng.choice(words, 300))
        for k in range(3):
            copy = list(base)
            for at in rng.choice(300, k, replace=False):
                copy[at] = "edited"
            group[len(rows)] = i
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    assert len(out) == len(rows) and out[901] == 900
    assert all(group[out[i]] == g for i, g in group.items())
    assert sum(out[i] == 3 * g for i, g in group.items()) >= 0.95 * len(group)


def test_near_copies_at_the_similarity_against_brute_force(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(2000)]
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    rows = []
    for i in range(120):
        base = list(rng.choice(words, 150))
        copy = list(base)
        for at in rng.choice(150, 1 + i % 5, replace=False):
            copy[at] = f"edit{i}"
        rows += [base, copy]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    alike = []
    for i in range(0, len(rows), 2):
        a, b = shingles(rows[i]), shingles(rows[i + 1])
        same = len(a & b) / len(a | b)
        if same >= 0.8:
            alike.append((same, out[i + 1] == i))
        else:
            assert out[i + 1] == i + 1
    assert sum(s < 0.9 for s, _ in alike) > 30
    assert sum(hit for _, hit in alike) >= 0.98 * len(alike)


def test_one_original_of_each_group_whatever_the_ids(spark):
    words = [f"w{i}" for i in range(60)]
    text, other = " ".join(words), " ".join(reversed(words))
    rows = [(3, text, 1), (3, text, 2), (3, other, 3), (None, text, 4), (None, other + " more", 5), (None, None, 6), (8, "", 7), (2, text + " end", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    out = simhash.near_copies(docs.withColumnRenamed("node", "mark"), keep=["text", "mark"]).collect()
    assert sorted((r["text"] or "", r["mark"]) for r in out) == sorted((t or "", m) for _, t, m in rows)
    groups = {}
    for r in out:
        groups.setdefault(r["component_id"], []).append((r["mark"], r["original"]))
    assert {k: sorted(m for m, _ in v) for k, v in groups.items()} == {2: [1, 2, 4, 8], 3: [3, 5], 8: [6, 7]}
    assert {k: [m for m, o in v if o] for k, v in groups.items()} == {2: [8], 3: [3], 8: [7]}
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_two_texts_with_one_id_are_not_linked_by_it(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "p q r s t u v"), (0, "p q r s t u v")], "doc_id long, text string")
    out = simhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == [(0, 0), (1, 0), (1, 1)]


def test_fingerprints_meet_at_the_similarity():
    """The share of pairs at 0.8 that a turn of near copies' fingerprints finds is as calculated."""
    rng = np.random.default_rng(9)
    seeds = rng.integers(1 << 63, size=simhash.PRINTS + 1, dtype=np.uint64)
    met = np.zeros(simhash.TURNS)
    for _ in range(200):
        pool = rng.integers(1 << 63, size=200, dtype=np.uint64)
        both = np.stack([simhash.sketch(pool[at], seeds) for at in (slice(0, 180), slice(20, 200))])  # 160 of 200 in common
        found = [len(simhash.close(both[:, t // 2].copy(), both[:, simhash.PRINTS].copy(), bool(t % 2))[0]) > 0 for t in range(simhash.TURNS)]
        assert any(found)
        met += found
    assert 0.11 < met.mean() / 200 < 0.16
    apart = np.stack([simhash.sketch(rng.integers(1 << 63, size=200, dtype=np.uint64), seeds) for _ in range(300)])
    assert not any(len(simhash.close(apart[:, t // 2].copy(), apart[:, simhash.PRINTS].copy(), bool(t % 2))[0]) for t in range(simhash.TURNS))


def test_a_crowd_of_near_copies_and_a_common_passage_make_no_pairs_of_all(spark, monkeypatch):
    rng = np.random.default_rng(10)
    words = [f"w{i}" for i in range(5000)]
    base, passage = list(rng.choice(words, 120)), list(rng.choice(words, 80))
    texts = []
    for i in range(400):
        copy = list(base)
        for at in rng.choice(120, 1 + i % 4, replace=False):  # some are not near the base, but near some other
            copy[at] = f"edit{i}"
        texts += [copy, passage + list(rng.choice(words, 30))]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    a, b = np.triu_indices(len(texts), 1)
    same = np.array([len(sets[i] & sets[j]) for i, j in zip(a, b, strict=True)])
    size = np.array([len(x) for x in sets])
    near = same >= 0.8 * (size[a] + size[b] - same) - 1e-9
    root = simhash.forest(len(texts), a[near], b[near])
    verified, similar = [], simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda pairs, *more: verified.append(pairs.count()) or similar(pairs, *more))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    assert [out[i] for i in range(len(texts))] == root.tolist()
    assert sum(verified) < 10 * len(texts)


def test_few_links_are_connected_in_few_jobs(spark):
    """What rounds of stars give, links back and forth, repeated ones and self-links included, without their jobs."""
    rng = np.random.default_rng(5)
    path = [(i, i + 1) for i in range(40)]
    chance = [(int(a), int(b)) for a, b in rng.integers(-(1 << 62), 1 << 62, 30)[rng.integers(0, 30, (20, 2))]]
    links = spark.createDataFrame(path + [(b, a) for a, b in path[:5]] + path[-3:] + [(7, 7), (99, 99)] + chance, "a long, b long")
    context = spark.sparkContext
    found, jobs = {}, {}
    for name, connect in (("one", simhash.connect), ("stars", components), ("many", lambda x: simhash.connect(x, few=10))):
        context.setJobGroup(name, name)
        found[name] = sorted((r["node"], r["root"]) for r in connect(links).collect())
        jobs[name] = len(context.statusTracker().getJobIdsForGroup(name))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert found["one"] == found["stars"] == found["many"]
    assert [(i, 0) for i in range(1, 41)] == [x for x in found["one"] if 0 < x[0] <= 40 and x[1] == 0]
    assert jobs["one"] <= 8 < jobs["stars"] < jobs["many"]
    assert simhash.connect(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0
