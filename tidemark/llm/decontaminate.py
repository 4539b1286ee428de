"""Benchmark passages in documents, with edits.

Texts are sequences of words. A random walk embeds a sequence of n words in some three steps a word: at each step it
writes the word it stands on and moves on or stays, by a bit of that word's hash which differs by step; past the last
word it writes padding (CGK). Sequences that differ by few edits fall into step again soon after each edit, so that
their embeddings agree at most steps: edit distance becomes Hamming distance. Tables sample a few steps of the
embedding each, from all along it; an item and a window that agree on all samples of a table are a candidate pair.

Windows are as long as the items that they are held against: items fall into classes by length, an eighth apart, and a
class embeds windows of its shortest item's length. A window starts at every word of every document, but for those
that provably hold no item of the class: an edit changes two pairs of adjacent words at most, so that around a match
at least n - 1 - 2k pairs of words are an item's.

How many walks are used follows from the recall wanted, measured in every class on items edited as much as a match
may differ, in several ways: at random, evenly, in one place, at the head, at the tail, head or tail missing.
Candidates are verified by exact edit distance of the whole item. Items of under ``MIN_WALK`` words allow no edit,
so they are looked up as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIMILARITY = 0.8
#: Recall wanted, and the least that a class may have with all walks.
RECALL, LEAST_RECALL = 0.95, 0.9
#: Items with fewer words are looked up exactly.
MIN_WALK = 5
#: Steps that a table samples, tables of one walk, walks at most.
SAMPLES, TABLES, WALKS = 3, 24, 6
#: Steps that the samples of every other table lie within; those of the rest lie anywhere.
SPAN = 8
#: Edited items that the recall of a class is measured on, in each way.
TRIALS = 24
#: Bytes that are split at once, windows whose walks advance together, words whose candidates are verified together.
PIECE, TOGETHER, HELD = 1 << 18, 1 << 13, 1 << 20
#: Words of items that one pass over the documents looks for.
PASS_WORDS = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
PAD = np.uint64(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64)


_ROOM = PIECE + 1
_UP = _powers(_BASE, _ROOM)
_DOWN = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), _ROOM)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(text: bytes) -> np.ndarray:
    """Hashes of the words of a text of any length, piece by piece; a word that spans pieces is hashed whole."""
    if len(text) <= PIECE:
        return _words(np.frombuffer(text, np.uint8))
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= at:
                at, found = _long_word(text, at)
                out.append(found)
                continue
            end = cut
        out.append(_words(np.frombuffer(text[at:end], np.uint8)))
        at = end
    return np.concatenate(out)


def _long_word(text: bytes, at: int) -> tuple[int, np.ndarray]:
    """Where the first word from ``at`` on ends, and its hash: that of its pieces, each at its place."""
    total, up, started = np.zeros(1, np.uint64), np.ones(1, np.uint64), False
    while at < len(text):
        data = np.frombuffer(text[at : at + PIECE], np.uint8)
        if not started:
            skip = int(np.argmin(_SPACE[data])) if _SPACE[data[0]] else 0
            data, at, started = data[skip:], at + skip, True
        gap = np.flatnonzero(_SPACE[data])
        n = int(gap[0]) if len(gap) else len(data)
        total += ((data[:n].astype(np.uint64) + np.uint64(1)) * _UP[:n]).sum(dtype=np.uint64) * up
        up *= _UP[n]
        at += n
        if len(gap):
            break
    return at, mix(total)


def _words(data: np.ndarray) -> np.ndarray:
    """Hashes of the runs without white space."""
    gap = np.r_[True, _SPACE[data], True]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], dtype=np.uint64)]
    return mix((total[end] - total[start]) * _DOWN[start])


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]]


def adjacent(tokens: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of adjacent words."""
    return mix(tokens[:-1] * _BASE + tokens[1:])


@dataclass
class Class:
    """Items of about the same length and the tables that look for them."""

    size: int  # words of a window: of the shortest item
    lead: int  # words that a match may lack at its head
    reach: int  # words that the longest item's match may take, with as many again before and after it
    least: int  # pairs of adjacent words of items around a match, at least
    items: np.ndarray
    pairs: np.ndarray  # bitmap of the items' pairs of adjacent words, by the leading bits of their hash
    samples: np.ndarray  # walks x tables x samples: the steps sampled, in order
    keys: list[list[np.ndarray]] = field(default_factory=list)  # by walk and table; sorted
    owners: list[list[np.ndarray]] = field(default_factory=list)


@dataclass
class Searcher:
    ids: list
    items: list[np.ndarray]
    seeds: np.ndarray
    classes: list[Class]
    similarity: float
    walks: int
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: sorted hashes, items
    recall: dict[int, float] = field(default_factory=dict)  # as measured, by words of a class's windows

    def search(self, texts: Sequence[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, end, edits) of each item in each text, the best place."""
        found: list[tuple[int, int, int, int, int]] = []
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            tokens = words(text)
            if not len(tokens):
                continue
            held.append((i, tokens))
            size += len(tokens)
            if size >= HELD:
                found += self._search(held)
                held, size = [], 0
        return found + (self._search(held) if held else [])

    def _search(self, held: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int, int, int]]:
        # words of no text around each one, so that windows may begin before a text whose match lacks its head
        lead = max((c.lead for c in self.classes), default=0)
        pad = mix(PAD + np.arange(lead + max((c.reach for c in self.classes), default=0), dtype=np.uint64))
        flat = np.concatenate([pad[:lead], *(x for _, t in held for x in (t, pad))])
        sizes = np.array([len(t) for _, t in held])
        base = np.cumsum(np.r_[lead, sizes[:-1] + len(pad)])
        out = self.exact(held)
        pairs = self.likely(flat, self.candidates(flat))
        if not len(pairs):
            return out
        doc = np.searchsorted(base - lead, pairs[:, 0], "right") - 1
        order = np.lexsort((pairs[:, 0], pairs[:, 1], doc))
        doc, at, item = doc[order], pairs[order, 0], pairs[order, 1]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
        for a, b in zip(new.tolist(), np.r_[new[1:], len(doc)].tolist(), strict=True):
            begin, tokens = int(base[doc[a]]), held[int(doc[a])][1]
            if best := self.verify(tokens, at[a:b] - begin, self.items[int(item[a])]):
                out.append((held[int(doc[a])][0], int(item[a]), *best))
        return out

    def exact(self, held: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int, int, int]]:
        """The first place of each short item in each text."""
        out = []
        for n, (keys, owners) in self.short.items():
            for i, tokens in held:
                if len(tokens) < n:
                    continue
                own = runs(tokens, n)
                low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
                seen = set()
                for at in np.flatnonzero(high > low).tolist():
                    for item in owners[low[at] : high[at]].tolist():
                        if item not in seen and (self.items[item] == tokens[at : at + n]).all():
                            seen.add(item)
                            out.append((i, item, at, at + n, 0))
        return out

    def candidates(self, flat: np.ndarray) -> np.ndarray:
        """(start, item) pairs of which a window agrees in a table."""
        found = []
        grams = np.r_[adjacent(flat), PAD] >> np.uint64(64 - PAIR_BITS)
        for c in self.classes:
            hits = np.cumsum(np.r_[0, c.pairs.take(grams.view(np.int64))], dtype=np.int32)
            near = hits[np.minimum(np.arange(c.reach, len(hits) - 1 + c.reach), len(hits) - 1)] - hits[:-1] >= c.least
            starts = np.flatnonzero(near)
            for at in range(0, len(starts), TOGETHER):
                start = starts[at : at + TOGETHER]
                window = flat[np.minimum(start[:, None] + np.arange(c.size), len(flat) - 1)]
                for w in range(self.walks):
                    keys, _ = walk(window, c.samples[w], self.seeds[w])
                    for t in range(len(keys)):
                        own, wanted = c.keys[w][t], keys[t]
                        low = np.searchsorted(own, wanted)
                        hit = np.flatnonzero(own.take(low, mode="clip") == wanted) if len(own) else low[:0]
                        if len(hit):
                            low, high = low[hit], np.searchsorted(own, wanted[hit], "right")
                            n = high - low
                            row = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                            found.append(c.owners[w][t][row] * len(flat) + np.repeat(start[hit], n))
        if not found:
            return np.zeros((0, 2), np.int64)
        item, start = np.divmod(distinct(np.concatenate(found)), len(flat))
        return np.stack([start, item], 1)

    def allowed(self, item: np.ndarray) -> int:
        """Edits of an item at most."""
        return int(len(item) * (1 - self.similarity) + 1e-9)

    def likely(self, flat: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Pairs around whose start enough pairs of adjacent words are the item's: an edit changes two at most."""
        if not len(pairs):
            return pairs
        grams = (np.r_[adjacent(flat), PAD] >> np.uint64(48)).astype(np.int64)
        own = np.zeros(1 << 16, bool)
        cut = np.flatnonzero(np.r_[True, pairs[1:, 1] != pairs[:-1, 1]])
        kept = []
        for a, b in zip(cut.tolist(), np.r_[cut[1:], len(pairs)].tolist(), strict=True):
            item = self.items[int(pairs[a, 1])]
            most = self.allowed(item)
            wanted = adjacent(item) >> np.uint64(48)
            own[wanted] = True
            if (b - a) * (len(item) + 2 * most + 2) < len(flat):
                same = own[grams[np.clip(pairs[a:b, :1] + np.arange(-most - 1, len(item) + most + 1), 0, len(grams) - 1)]].sum(axis=1)
            else:
                place = np.flatnonzero(own[grams])
                low, high = (np.searchsorted(place, pairs[a:b, 0] + k) for k in (-most - 1, len(item) + most + 1))
                same = high - low
            kept.append(pairs[a:b][same >= len(item) - 1 - 2 * most])
            own[wanted] = False
        return np.concatenate(kept)

    def reached(self, trials: list[tuple[int, int, int, np.ndarray]]) -> dict[int, float]:
        """By class, the least share of the edited items (class, way, item, words) that is found, of all ways of editing."""
        found = {(k, item) for k, item, *_ in self._search([(k, t[3]) for k, t in enumerate(trials)])}
        hits: dict[tuple[int, int], list[bool]] = {}
        for k, (size, way, item, _) in enumerate(trials):
            hits.setdefault((size, way), []).append((k, item) in found)
        out: dict[int, float] = {}
        for (size, _), seen in hits.items():
            out[size] = min(out.get(size, 1.0), sum(seen) / len(seen))
        return out

    def verify(self, tokens: np.ndarray, starts: np.ndarray, item: np.ndarray) -> tuple[int, int, int] | None:
        """The place near the starts with the fewest edits, if few enough."""
        n = len(item)
        most = self.allowed(item)
        slack = most + 1
        best = None
        at = 0
        while at < len(starts):
            end = at
            while end + 1 < len(starts) and starts[end + 1] - starts[end] <= slack and starts[end + 1] - starts[at] <= n:
                end += 1
            a, b = max(0, int(starts[at]) - slack), min(len(tokens), int(starts[end]) + n + slack)
            edits, s, e = place(item, tokens[a:b])
            if edits <= most and (best is None or edits < best[2]):
                best = (a + s, a + e, edits)
            at = end + 1
        return best


#: Bits of a pair's hash that its bitmap goes by.
PAIR_BITS = 22


def runs(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words."""
    out = np.zeros(len(tokens) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * _BASE + tokens[k : len(tokens) - n + 1 + k])
    return out


def walk(windows: np.ndarray, samples: np.ndarray, seed: np.uint64) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys of the windows' walks by table, and which of them sample padding; a row of ``windows`` is a window's words."""
    n, size = windows.shape
    padded = np.empty((n, size + 1), np.uint64)
    padded[:, :size] = windows
    padded[:, size] = PAD
    flat = padded.ravel()
    place = np.arange(n, dtype=np.int64) * (size + 1)
    end = place + size
    due: dict[int, list[int]] = {}
    for t, steps in enumerate(samples.tolist()):
        for step in steps:
            due.setdefault(step, []).append(t)
    keys = [np.zeros(n, np.uint64) for _ in samples]
    blank = [np.zeros(n, bool) for _ in samples]
    mixed = flat
    for step in range(int(samples.max()) + 1):
        if step % 64 == 0:
            mixed = mix(flat ^ (seed + np.uint64(step)))
        here = mixed.take(place)
        for t in due.get(step, ()):
            keys[t] *= _BASE
            keys[t] += here
            blank[t] |= place == end
        bit = ((here >> np.uint64(step % 64)) & np.uint64(1)).view(np.int64)
        place += bit
        np.minimum(place, end, out=place)
    return keys, blank


def place(item: np.ndarray, tokens: np.ndarray) -> tuple[int, int, int]:
    """Fewest edits that turn the item into a run of the tokens, and where that run starts and ends."""
    m = len(tokens)
    column = np.arange(m + 1)
    cost = np.zeros(m + 1, np.int64)
    origin = column.copy()
    diagonal, before = np.empty(m + 1, np.int64), np.zeros(m + 1, np.int64)
    for word in item:
        up = cost + 1
        diagonal[0] = up[0] + 1
        np.add(cost[:-1], tokens != word, out=diagonal[1:])
        before[1:] = origin[:-1]
        new = np.minimum(up, diagonal)
        source = np.where(diagonal <= up, before, origin)
        run = new - column
        low = np.minimum.accumulate(run)
        at = np.maximum.accumulate(np.where(run == low, column, 0))
        cost, origin = low + column, source[at]
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


def edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = item.tolist()
    for _ in range(edits):
        kind, at = int(rng.integers(3)), int(rng.integers(max(1, len(out))))
        new = int(rng.integers(1 << 63))
        if kind == 0 and out:
            out[at] = new
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, new)
    return np.array(out, np.uint64)


def trials_of(item: np.ndarray, edits: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The item with so many edits, in each of the ways that the recall is measured for."""
    new = rng.integers(1 << 63, size=edits, dtype=np.uint64)
    even = item.copy()
    even[np.linspace(0, len(item) - 1, edits + 2)[1:-1].astype(int)] = new
    at = int(rng.integers(len(item) - edits + 1))
    return [
        edited(item, edits, rng),
        even,
        np.r_[item[:at], new, item[at + edits :]],
        np.r_[item[:at], new, item[at:]],
        np.r_[new, item[edits:]],
        item[edits:],
        np.r_[item[: len(item) - edits], new],
        item[: len(item) - edits],
    ]


def class_of(words: int) -> int:
    """Lengths of a class are an eighth apart at most; short ones are their own."""
    step = max(1, 1 << max(0, words.bit_length() - 4))
    return words // step * step


def build(ids: list, texts: list[str], similarity: float = SIMILARITY, recall: float = RECALL, seed: int = 7, min_words: int = 1) -> Searcher:
    """Tables for the items of so many words or more; as many walks as reach the recall in each class and for each way of editing.

    Raises an error if a class has not even ``LEAST_RECALL`` with all walks; ``recall`` of the result says what was measured.
    """
    items = [words(t.lower().encode()) for t in texts]
    rng = np.random.default_rng(seed)
    seeds = rng.integers(1 << 63, size=WALKS, dtype=np.uint64)
    by: dict[int, list[int]] = {}
    short: dict[int, list[int]] = {}
    for i, t in enumerate(items):
        if len(t) >= MIN_WALK:
            by.setdefault(class_of(len(t)), []).append(i)
        elif len(t) >= max(1, min_words):
            short.setdefault(len(t), []).append(i)
    looked = {}
    for n, own in short.items():
        keys = np.concatenate([runs(items[i], n) for i in own])
        order = np.argsort(keys, kind="stable")
        looked[n] = keys[order], np.array(own)[order]
    out = Searcher(ids, items, seeds, [], similarity, 0, looked)
    for _, own in sorted(by.items()):
        sizes = [len(items[i]) for i in own]
        size, most = min(sizes), max(out.allowed(items[i]) for i in own)
        pairs = np.zeros(1 << PAIR_BITS, bool)
        pairs[np.concatenate([adjacent(items[i]) for i in own]) >> np.uint64(64 - PAIR_BITS)] = True
        steps = 2 * size  # as many as a walk has inside its window; the third step a word is padding
        samples = np.zeros((WALKS, TABLES, SAMPLES), np.int64)
        for w in range(WALKS):
            for t in range(TABLES):
                first = (steps - 1) * t // TABLES
                near = np.arange(first, min(first + SPAN, steps)) if t % 2 == 0 and steps - first > SAMPLES else np.arange(steps)
                samples[w, t] = np.sort(rng.choice(near, SAMPLES, replace=False))
        least = min(len(items[i]) - 1 - 2 * out.allowed(items[i]) for i in own)
        out.classes.append(Class(size, most, max(sizes) + 2 * most + 1, least, np.array(own), pairs, samples))
    trials = []
    for c in out.classes:
        picked = rng.choice(c.items, TRIALS, replace=len(c.items) < TRIALS).tolist()
        trials += [(c.size, way, i, t) for i in picked for way, t in enumerate(trials_of(items[i], out.allowed(items[i]), rng))]
    while out.classes:
        for c in out.classes:
            window = np.stack([items[i][: c.size] for i in c.items])
            keys, blank = walk(window, c.samples[out.walks], seeds[out.walks])
            c.keys.append([])
            c.owners.append([])
            for key, skip in zip(keys, blank, strict=True):
                key, owner = key[~skip], c.items[~skip]
                order = np.argsort(key, kind="stable")
                c.keys[-1].append(key[order])
                c.owners[-1].append(owner[order])
        out.walks += 1
        out.recall = out.reached(trials)
        if min(out.recall.values()) >= recall:
            break
        if out.walks == WALKS:
            if (worst := min(out.recall.values())) < LEAST_RECALL:
                raise RuntimeError(f"{WALKS} walks find {worst:.2f} of the edited items of a class, less than a recall of {LEAST_RECALL}")
            break
    return out


def passes(benchmark: DataFrame, similarity: float, recall: float, min_words: int) -> Iterator[Searcher]:
    """Searchers for the items, so many at once as have ``PASS_WORDS`` words together; items come to the driver one such part at a time."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for row in benchmark.where("text is not null").select("item_id", "text").orderBy("item_id").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += 1 + row["text"].count(" ")
        if held >= PASS_WORDS:
            yield build(ids, texts, similarity, recall, min_words=min_words)
            ids, texts, held = [], [], 0
    if ids:
        yield build(ids, texts, similarity, recall, min_words=min_words)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, min_words: int = 1) -> DataFrame:
    """doc_id, item_id, first_word, end_word, edits, similarity: one row for each item that a document holds.

    ``similarity`` is 1 - edits / words of the item, at least as asked for; letters' case is ignored. Of several places
    with the same edits the first is given. Null items and those with fewer than ``min_words`` words are not looked
    for, null and empty texts hold none, repeated rows are searched each, texts of any length are searched whole, other
    columns are ignored whatever their names, and an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, first_word long, end_word long, edits long, similarity double"
    out = spark.createDataFrame([], schema)
    for searcher in passes(benchmark, similarity, recall, min_words):
        shared = spark.sparkContext.broadcast(searcher)  # PASS_WORDS words of items at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = shared.value
            for batch in batches:
                doc = batch.column(0).to_pylist()
                found = searcher.search([(t or "").lower().encode() for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([doc[r[0]] for r in found], pa.int64()),
                        "item_id": pa.array([searcher.ids[r[1]] for r in found], pa.int64()),
                        "first_word": pa.array([r[2] for r in found], pa.int64()),
                        "end_word": pa.array([r[3] for r in found], pa.int64()),
                        "edits": pa.array([r[4] for r in found], pa.int64()),
                        "similarity": pa.array([1 - r[4] / len(searcher.items[r[1]]) for r in found], pa.float64()),
                    }
                )

        out = out.union(rows.mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, *keep: Column, similarity: float = SIMILARITY, recall: float = RECALL, min_words: int = 1) -> DataFrame:
    """The kept columns and text of the rows that hold no item, row by row: neither ids nor their repeats matter.

    Otherwise as ``leaks``; ``keep`` must not name a column text.
    """
    spark = docs.sparkSession
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    for searcher in passes(benchmark, similarity, recall, min_words):
        shared = spark.sparkContext.broadcast(searcher)  # PASS_WORDS words of items at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.num_columns - 1).to_pylist()
                held = {r[0] for r in shared.value.search([(t or "").lower().encode() for t in texts])}
                yield batch.filter(pa.array([i not in held for i in range(len(texts))], pa.bool_()))

        rows = rows.mapInArrow(run, rows.schema)
    return rows
