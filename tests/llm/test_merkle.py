import hashlib

import numpy as np
import xxhash

from tidemark.llm import merkle


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, n = t or "", (order[(k + 1) % len(order)][1] or "")
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), merkle.fingerprint(t), merkle.fingerprint(e), merkle.likeness(merkle.fingerprint(t), merkle.fingerprint(n)))
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"wörd{i}" for i in range(99)] + ["end.\n", "stop!", "x.\n\n"]
    rows = [(int(i), " ".join(rng.choice(words, int(rng.integers(0, 200))))) for i in rng.permutation(400)[:150] - 30]
    rows[3] = (rows[3][0], None)
    rows[4] = (rows[4][0], "")
    out = merkle.neighbours(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_next"]) for r in out} == brute(rows)
    long = [r["near_edited"] for r in out if r["n_chars"] > 600]
    assert 0.35 < np.mean(long) < 0.65 and all(0 <= r["near_edited"] <= 1 for r in out)


def test_single_null_repeated_and_no_rows(spark):
    run = lambda rows: merkle.neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    one = run([(1, "abcd")])
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one[0]["near_next"] == 1
    several = run([(1, "abcd"), (1, "abcd"), (None, "x" * 100_000), (None, None)])
    assert len(several) == 4 and len({r["fingerprint"] for r in several if r["doc_id"] == 1}) == 1
    assert run([]) == []


def test_differences_locate_edits():
    parts = [f"Sentence {i} is here." + ("\n\n" if i % 7 == 6 else "\n" if i % 3 == 2 else " ") for i in range(60)]
    old = "".join(parts)
    parts[30] = "Something new."
    new = "".join(parts)
    a, b = merkle.fingerprint(old), merkle.fingerprint(new)
    assert merkle.differences(a, a) == [] and merkle.likeness(a, a) == 1.0
    ((start, end),) = merkle.differences(a, b)
    assert new[start:end].startswith("Something new.") and end - start < 60
    assert merkle.fingerprint("") == merkle.fingerprint("") and merkle.likeness(merkle.fingerprint(""), a) == 0
    cut = merkle.SHORTER.findall("word " * 100)
    assert "".join(cut) == "word " * 100


def test_order_counts_and_size_is_bounded():
    rng = np.random.default_rng(9)
    parts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 999, 12)) + ".\n" for _ in range(300)]
    text, other = "".join(parts), "".join(rng.permutation(parts))
    a, b = merkle.fingerprint(text), merkle.fingerprint(other)
    assert merkle.likeness(a, b) < 0.3
    assert max(len(merkle.fingerprint(x)) for x in (text, text * 50, text.replace("\n", "\n\n"), text.replace(" ", ""))) < 2400
    changed = text[:3000] + "XX" + text[3000:]
    spans = merkle.differences(a, merkle.fingerprint(changed))
    assert any(s <= 3000 < e for s, e in spans) and sum(e - s for s, e in spans) < 0.25 * len(changed)
    assert 0.8 < merkle.likeness(a, merkle.fingerprint(changed)) < 1


def test_equal_nodes_in_order_against_brute_force():
    rng = np.random.default_rng(10)

    def brute(x, y):
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x, 1):
            for j, b in enumerate(y, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + (a[1] if a[:2] == b[:2] else 0))
        return best[-1][-1]

    for _ in range(300):
        nodes = [(int(k), int(k) % 5 + 1, 0) for k in range(6)]
        x, y = ([nodes[int(k)] for k in rng.integers(0, 6, int(rng.integers(0, 12)))] for _ in range(2))
        pairs = merkle._common(x, y)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert all(x[i][:2] == y[j][:2] for i, j in pairs)
        assert sum(x[i][1] for i, _ in pairs) <= brute(x, y)
        inner = sum(x[i][1] for i, _ in pairs)
        assert inner == brute(x, y) or x[:1] == y[:1] or x[-1:] == y[-1:]  # common ends are taken first


def test_known_leaves_are_those_of_the_whole_text():
    rng = np.random.default_rng(12)
    bits = ["word ", "longer-words ", "end. ", "why? ", "line\n", "blank\n\n", "ab" * 30, " "]
    for _ in range(300):
        a, b = ("".join(rng.choice(bits, int(rng.integers(0, 60)))) for _ in range(2))
        at = int(rng.integers(0, len(a) + 1))
        edited = a[:at] + b
        assert merkle.leaves(edited, merkle.leaves(a), at) == merkle.leaves(edited)


def test_many_rows_of_one_id(spark):
    rng = np.random.default_rng(13)
    rows = [(None if i % 3 else i, " ".join(f"w{int(x)}" for x in rng.integers(0, 99, 12))) for i in range(600)] + [(5, f"five {i}") for i in range(300)]
    out = merkle.neighbours(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int")).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in rows)
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    order = sorted(rows, key=lambda r: (-r[0] if r[0] is not None else 1 << 63, signed(r[1])))
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]).encode()).hexdigest() for k, (_, t) in enumerate(order))
    assert sorted(r["edited_sha256"] for r in out) == want
