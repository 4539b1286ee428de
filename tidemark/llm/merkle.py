"""Document fingerprints as Merkle trees.

Leaves are sentences (long ones without marks are cut at places that their letters choose). A leaf's end has a
rank: 1 if a line ends there, 2 if a blank line follows, and more by its hash, each further one in ``FAN`` leaves. A
node of level k is a run of leaves up to the next end of rank k or more: level 1 are paragraphs, level 2 sections, and
so on up to one top node. A node's hash is that of its children's hashes, in order. All cuts follow content, so
that an edit changes the nodes above it only. Equal roots mean equal texts; comparing two trees goes down from the
root, passes over equal branches in order and opens the others.

A fingerprint is a digest of bounded size: the root's 32 hexadecimal digits, then the levels from the top down to
the finest that has ``NODES`` nodes at most, each node as 8 digits of its hash, its length and its number of children.
Texts of any length have some hundred bytes; what lies below the finest level is in its nodes' hashes.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import binary, partitions

SENTENCE = re.compile(r"[^.!?\n。！？]*+[.!?\n。！？]++\s*+|[^.!?\n。！？]++")
#: A sentence of more characters is cut.
LONG = 40
SHORTER = re.compile(r".+?(?:(?:[aeo0258]|[^\w\s])\s(?=\S{4})|$)", re.S)
#: A sentence that ends so many characters before a change is cut as without it.
LOOK = 8
#: One end in so many (a power of two) reaches the next level; nodes that a fingerprint's finest level has at most.
FAN_BITS, NODES = 2, 96
BUCKETS = 2
LOWEST = -(1 << 63)

#: hash, length, children
Node = tuple[int, int, int]


@dataclass
class Leaves:
    """Hashes, lengths and ranks of a text's leaves, and (leaves, characters) up to the end of each sentence."""

    hashes: list[int]
    sizes: list[int]
    ranks: list[int]
    ends: list[tuple[int, int]]


def leaves(text: str, known: Leaves | None = None, same: int = 0) -> Leaves:
    """The leaves of a text; ``known`` are those of another that has the first ``same`` characters in common."""
    digest = xxhash.xxh64_intdigest
    hashes, sizes, ranks, ends, at = [], [], [], [], 0
    if known is not None:
        k = bisect.bisect_right(known.ends, same - LOOK, key=lambda e: e[1]) - 1
        if k >= 0:
            n, at = known.ends[k]
            hashes, sizes, ranks, ends = known.hashes[:n], known.sizes[:n], known.ranks[:n], known.ends[: k + 1]
    for sentence in SENTENCE.findall(text, at):
        for leaf in (sentence,) if len(sentence) <= LONG else SHORTER.findall(sentence):
            h = digest(leaf.encode("utf-8", "surrogatepass"))
            hashes.append(h)
            sizes.append(len(leaf))
            ranks.append(((h & -h).bit_length() - 1) // FAN_BITS if h else 0)
        if "\n" in sentence:
            ranks[-1] += 2 if "\n\n" in sentence else 1
        at += len(sentence)
        ends.append((len(hashes), at))
    return Leaves(hashes, sizes, ranks, ends)


def tree(found: Leaves) -> list[list[Node]]:
    """Levels of nodes from the leaves up to a level of one node at most."""
    ranks = found.ranks
    levels = [[(h, n, 0) for h, n in zip(found.hashes, found.sizes, strict=True)]]
    digest = xxhash.xxh64_intdigest
    while len(levels[-1]) > 1:
        k = len(levels)
        out, kept, first = [], [], 0
        below = levels[-1]
        last = len(below) - 1
        for i, rank in enumerate(ranks):
            if rank >= k or i == last:
                part = below[first : i + 1]
                out.append((digest(b"".join([h.to_bytes(8, "little") for h, _, _ in part])), sum([n for _, n, _ in part]), len(part)))
                kept.append(rank)
                first = i + 1
        levels.append(out)
        ranks = kept
    return levels


def fingerprint(text: str, found: Leaves | None = None) -> str:
    levels = tree(found or leaves(text))
    base = next((k for k, level in enumerate(levels) if len(level) <= NODES), len(levels) - 1)
    # the root covers the text itself too, so that equality does not hang on 64 bits of a node
    top = b"".join(h.to_bytes(8, "little") for h, _, _ in levels[-1])
    root = xxhash.xxh3_128_hexdigest(top + xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
    shown = [f"{k}:" + " ".join([f"{h >> 32:08x}{n:x}" + (f".{c:x}" if k > base else "") for h, n, c in levels[k]]) for k in range(len(levels) - 1, base - 1, -1)]
    return f"{root}/{'/'.join(shown)}"


def _levels(print_: str) -> dict[int, list[Node]]:
    """Nodes by level."""
    out: dict[int, list[Node]] = {}
    for part in print_[33:].split("/"):
        k, _, nodes = part.partition(":")
        out[int(k)] = [(int(x[:8], 16), int(n, 16), int(c or "0", 16)) for x in nodes.split() for n, _, c in (x[8:].partition("."),)]
    return out


def _common(x: list[Node], y: list[Node]) -> list[tuple[int, int]]:
    """Pairs of equal nodes, in the order of both, with the most characters together."""
    pairs = []
    a, b = 0, min(len(x), len(y))
    while a < b and x[a][:2] == y[a][:2]:
        pairs.append((a, a))
        a += 1
    tail = []
    i, j = len(x), len(y)
    while i > a and j > a and x[i - 1][:2] == y[j - 1][:2]:
        i, j = i - 1, j - 1
        tail.append((i, j))
    places: dict[tuple[int, int], list[int]] = {}
    for at in range(a, j):
        places.setdefault(y[at][:2], []).append(at)
    meets = [(p, q) for p in range(a, i) for q in reversed(places.get(x[p][:2], ()))]
    if meets:  # best chain that ends at each place of y
        best: list[tuple[int, tuple | None]] = [(0, None)] * (j - a + 1)
        for p, q in meets:
            before = best[q - a]
            value = before[0] + x[p][1]
            for k in range(q - a + 1, len(best)):
                if best[k][0] >= value:
                    break
                best[k] = (value, ((p, q), before[1]))
        chain = best[-1][1]
        middle = []
        while chain is not None:
            middle.append(chain[0])
            chain = chain[1]
        pairs += reversed(middle)
    return pairs + tail[::-1]


def compare(a: str, b: str) -> tuple[int, list[tuple[int, int]]]:
    """Characters in equal branches, and the ranges of characters of b in branches that differ, from the root down."""
    one, two = _levels(a), _levels(b)
    size = lambda levels: sum(n for _, n, _ in levels[min(levels)])
    if a[:32] == b[:32]:
        return size(two), []
    low, high = max(min(one), min(two)), min(max(one), max(two))
    if low > high:
        return 0, [(0, size(two))] if size(two) else []
    first = {id(levels): {k: [0, *accumulate(c for _, _, c in nodes)] for k, nodes in levels.items()} for levels in (one, two)}
    starts = {k: [0, *accumulate(n for _, n, _ in nodes)] for k, nodes in two.items()}
    same, ranges = 0, []
    stack = [(high, 0, len(one[high]), 0, len(two[high]))]
    while stack:
        k, p, p_end, q, q_end = stack.pop()
        x, y = one[k][p:p_end], two[k][q:q_end]
        pairs = _common(x, y)
        same += sum(x[i][1] for i, _ in pairs)
        gaps = []
        i0 = j0 = 0
        for i, j in [*pairs, (len(x), len(y))]:
            if i > i0 or j > j0:
                gaps.append((p + i0, p + i, q + j0, q + j))
            i0, j0 = i + 1, j + 1
        for i, i_end, j, j_end in gaps:
            if k > low and i < i_end and j < j_end:
                f, g = first[id(one)][k], first[id(two)][k]
                stack.append((k - 1, f[i], f[i_end], g[j], g[j_end]))
            elif j < j_end:
                ranges.append((starts[k][j], starts[k][j_end]))
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and out[-1][1] == s:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return same, out


def shared(a: str, b: str) -> tuple[float, list[tuple[int, int]]]:
    """Likeness and differences of two fingerprints."""
    if a[:32] == b[:32]:
        return 1.0, []
    same, ranges = compare(a, b)
    total = sum(sum(n for _, n, _ in levels[min(levels)]) for levels in map(_levels, (a, b)))
    return 2 * same / total if total else 0.0, ranges


def likeness(a: str, b: str) -> float:
    """Share of both texts' characters in equal branches, which count in their order only; 1 if the roots are equal."""
    return shared(a, b)[0]


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """Ranges of characters of b in branches that a doesn't have, found from the root down, as fine as the fingerprint's finest level."""
    return compare(a, b)[1]


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, first_edit for every row.

    The edited text has the last half of a text (its length halved, rounded down) replaced by as many leading
    characters of the next document's text, or all. Next is by descending doc_id, null last, and the first after
    the last; rows with the same id follow each other in an order that depends on their texts only. Null texts
    count as empty. A table without rows gives none; a single row is its own next. Repeated rows are fingerprinted each;
    texts of any length have a fingerprint of bounded size; other columns are ignored, whatever their names.
    ``first_edit`` is where the first differing branch begins in the edited text, null if none differs.

    Ids are cut at quantiles into ranges; an id that many rows have, as null may be, is a range of its own and cut by a hash
    of their texts. Besides its own rows a range gets a copy of the row that follows its last one. Rows are sorted inside a
    partition and compared as they stream by.
    """
    spark = docs.sparkSession
    buckets = BUCKETS * partitions(spark)
    whole = F.col("text").cast("string")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"), F.xxhash64(F.coalesce(whole, F.lit(""))).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), whole.alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, first_edit long"
    ids = rows.select("id", "h")
    found = ids.approxQuantile("id", [i / buckets for i in range(1, buckets)], 0.5 / buckets)
    # ids with more rows than a range: fewer than there are ranges
    many = {int(v): n for v, n in zip(*np.unique(np.array(found, np.float64), return_counts=True), strict=True) if n > 1}
    hot = {r["id"]: r["n"] for r in ids.where(F.col("id").isin(list(many))).groupBy("id").agg(F.count("*").alias("n")).collect()} if many else {}
    room = max(1, docs.count() // buckets)
    parts = {v: -(-n // room) for v, n in hot.items() if n > room}
    cuts = np.unique(np.array([*(int(x) for x in found), *parts, *(v + 1 for v in parts if v < (1 << 63) - 1)], np.int64))
    most = max(parts.values(), default=1)
    hot_ids = np.array(sorted(parts), np.int64)
    shares = np.array([parts[v] for v in hot_ids.tolist()], np.int64)

    def place(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of a row's range; ranges follow each other by descending numbers."""
        part = np.zeros(len(x), np.int64)
        if len(hot_ids):
            at = np.minimum(np.searchsorted(hot_ids, x), len(hot_ids) - 1)
            mine = hot_ids[at] == x
            # hashes go up in the order of documents
            part[mine] = ((h[mine].astype(np.float64) / 2.0**64 + 0.5) * shares[at[mine]]).astype(np.int64).clip(0, shares[at[mine]] - 1)
        return np.searchsorted(cuts, x, "right") * most + (most - 1 - part)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place(batch.column(0).to_numpy(), batch.column(1).to_numpy())), batch.column(0), batch.column(1)], ["bucket", "id", "h"])

    leading = F.max(F.struct("id", (-1 - F.col("h")).alias("turned")))  # the greatest id, of its rows the least hash
    first = {r["bucket"]: (r["f"]["id"], -1 - r["f"]["turned"]) for r in ids.mapInArrow(bucket, "bucket long, id long, h long").groupBy("bucket").agg(leading.alias("f")).collect()}
    order = sorted(first, reverse=True)  # as documents follow each other
    before = {b: order[i - 1] for i, b in enumerate(order)}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        names = ["bucket", "copy", "id", "h", "doc_id", "z"]
        for batch in batches:
            x, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = place(x, h)
            z = pa.array([squeeze(t or b"") for t in binary(batch.column(3))], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(x), bool)), *batch.columns[:3], z], names)
            also = [i for i, row in enumerate(zip(own.tolist(), x.tolist(), h.tolist(), strict=True)) if first[row[0]] == row[1:]]
            if also:
                at = pa.array(also, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([before[own[i]] for i in also], pa.int64()), pa.array([True] * len(also)), *(c.take(at) for c in batch.columns[:3]), z.take(at)], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        held: tuple[int, int | None, str, Leaves, str] | None = None
        out: list[tuple] = []
        for batch in batches:
            for b, copy, doc_id, z in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4, 5)), strict=True):
                if copy and (held is None or held[0] != b):
                    held = None
                    continue
                text = expand(z).decode("utf-8", "surrogatepass")
                cut = leaves(text)
                own = fingerprint(text, cut)
                if held is not None and held[0] == b:
                    out.append(edit(*held[1:], text, own))
                held = None if copy else (b, doc_id, text, cut, own)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, made)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, made)

    made = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("first_edit", pa.int64())])
    dealt = rows.mapInArrow(spread, "bucket long, copy boolean, id long, h long, doc_id long, z binary").repartition(partitions(spark), "bucket")
    return dealt.sortWithinPartitions("bucket", "copy", F.desc("id"), "h", "z").mapInArrow(compare, schema)


def edit(doc_id: int | None, text: str, cut: Leaves, own: str, next_: str, next_print: str) -> dict:
    half = len(text) // 2
    edited = text[: len(text) - half] + next_[:half]
    edited_print = fingerprint(edited, leaves(edited, cut, len(text) - half))
    near, changed = shared(own, edited_print)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": own,
        "edited_fingerprint": edited_print,
        "near_edited": near,
        "near_next": likeness(own, next_print),
        "first_edit": changed[0][0] if changed else None,
    }
