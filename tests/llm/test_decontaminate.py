import numpy as np
import pytest

from tidemark.llm import decontaminate as d


def levenshtein_inside(item, doc):
    """Fewest edits between the item and any run of the document."""
    row = [0] * (len(doc) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(doc, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def corpus(rng, n=150, edits=0.2):
    vocab = np.array(["the", "of", "And", *(f"w{i}" for i in range(400))])
    say = lambda k: list(rng.choice(vocab, k))
    items = [say(int(rng.integers(5, 60))) for _ in range(25)]
    docs = []
    for i in range(n):
        text = say(int(rng.integers(0, 200)))
        if i % 2:
            item = list(items[int(rng.integers(len(items)))])
            for _ in range(int(rng.integers(0, int(len(item) * edits) + 1))):
                at = int(rng.integers(len(item)))
                if rng.random() < 0.4:
                    item[at] = "EDIT"
                elif rng.random() < 0.5:
                    del item[at]
                else:
                    item.insert(at, "more")
            text[len(text) // 2 : len(text) // 2] = item
        docs.append((i, " ".join(text)))
    return docs, [(i, "\n".join(t)) for i, t in enumerate(items)]


def run(spark, docs, items):
    out = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r["doc_id"], r["item_id"]): r for r in out}


def test_recall_and_exactness_against_brute_force(spark):
    docs, items = corpus(np.random.default_rng(3))
    want = {}
    for i, text in docs:
        for k, item in items:
            a, b = item.lower().split(), text.lower().split()
            if (n := levenshtein_inside(a, b)) <= int(len(a) * 0.2 + 1e-9):
                want[i, k] = n
    got = run(spark, docs, items)
    assert set(got) <= set(want)
    assert all(got[k]["edits"] >= want[k] for k in got)
    assert len(got) >= 0.9 * len(want)
    assert all(k in got for k, n in want.items() if n == 0)


@pytest.mark.parametrize("text", ["", " \n", "one two three"])
def test_words(text):
    assert len(d.words(text.encode())) == len(text.split())


def test_words_of_long_texts(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abc"), int(rng.integers(1, 6)))) for _ in range(500)).encode()
    whole = d.words(text)
    monkeypatch.setattr(d, "PIECE", 64)
    assert (d.words(text) == whole).all()
    assert len(d.words(b"a " + b"x" * 300 + b" b c")) == 4


def test_nulls_short_items_repeats_and_empty_tables(spark):
    item = "some words that make up a benchmark item of fair length and more"
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, item), (4, "clean text"), (5, "word " * 30_000 + item)]
    items = [(0, item), (1, None), (2, "a b"), (3, "")]
    out = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["3", "3", "5", "None"]
    assert {r["item_id"] for r in out} == {0}
    docs.append((6, "x A\tB y"))
    out = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r["first_word"], r["end_word"], r["edits"]) for r in out if r["item_id"] == 2] == [(1, 3, 0)]  # short items are looked up exactly
    few = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), min_words=5).collect()
    assert {r["item_id"] for r in few} == {0}
    assert run(spark, [], items) == {} == run(spark, docs, [])


def test_texts_without_any_candidate():
    searcher = d.build([0], ["some words that make up a benchmark item of fair length and more"])
    assert searcher.search([b"nothing alike", b""]) == [] == searcher.search([])


def test_a_word_longer_than_a_piece_is_hashed_whole(monkeypatch):
    long = bytes(np.random.default_rng(2).choice(list(b"abcdef"), 1000).astype(np.uint8))
    want = d.words(b"a " + long + b" b")
    monkeypatch.setattr(d, "PIECE", 64)
    assert (d.words(b"a " + long + b" b") == want).all()
    assert d.words(long[:500] + b"x")[0] != d.words(long[:500] + b"y")[0]


def test_rows_without_leaks(spark):
    item = "some words that make up a benchmark item of fair length and more"
    docs = [(1, None, "a"), (1, item, "b"), (1, "clean", "c"), (None, item, "d"), (None, "clean", "e"), (2, "clean", "f"), (2, "clean", "f")]
    rows = spark.createDataFrame(docs, "doc_id long, text string, words string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    kept = d.without_leaks(rows, bench, rows["doc_id"], rows["words"]).collect()
    assert sorted(r["words"] for r in kept) == ["a", "c", "e", "f", "f"]
    assert d.without_leaks(rows, bench.limit(0), rows["doc_id"]).count() == len(docs)
    assert d.without_leaks(rows.limit(0), bench, rows["doc_id"]).count() == 0


def test_items_in_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    items = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 99, 12))) for i in range(7)]
    monkeypatch.setattr(d, "PASS_WORDS", 30)
    assert set(run(spark, items, items)) == {(i, i) for i in range(7)}


@pytest.mark.parametrize("size", [5, 9, 16, 40, 60, 100, 200])
def test_items_whose_beginning_or_end_takes_all_edits(size):
    rng = np.random.default_rng(size)
    vocab = np.array([f"w{i}" for i in range(400)])
    items = [list(rng.choice(vocab, size)) for _ in range(40)]
    most = size // 5
    searcher = d.build(list(range(40)), [" ".join(i) for i in items])
    middle = size // 2
    ways = [
        lambda i: ["edit"] * most + i[most:],
        lambda i: i[most:],
        lambda i: i[:-most] + ["edit"] * most,
        lambda i: i[:-most],
        lambda i: i[:middle] + ["edit"] * most + i[middle:],
        lambda i: i[:middle] + i[middle + most :],
    ]
    for change in ways:
        for before in (0, 70):  # at the text's very start, and inside it
            texts = [" ".join([*rng.choice(vocab, before), *change(i), *rng.choice(vocab, before)]).encode() for i in items]
            found = {r[0]: r for r in searcher.search(texts) if r[0] == r[1]}
            assert len(found) >= 0.9 * len(items)
            assert all(r[4] <= most for r in found.values())


def test_too_low_a_recall_is_an_error(monkeypatch):
    monkeypatch.setattr(d.Searcher, "reached", lambda self, trials: {12: 0.0})
    with pytest.raises(RuntimeError, match="recall"):
        d.build([0], ["some words that make up a benchmark item of fair length and more"])
