"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits meet in a variant of both: of three differing bits one
side holds a one in two at least; it clears those two, and the other side flips the third. So a fingerprint
has as *near* variants itself and all its one-bit flips, and as *far* variants all those with two of its ones
cleared. A shared variant that is near for one of the two proves a distance of three at most, and each pair
within three shares one. Variants are dealt by their leading bits, and each task makes those of its own prefix:
a fingerprint travels to the few prefixes that its variants have instead of once a variant.

Equal fingerprints are one node, and in a variant's group all members are linked to one of them, so that a
group of n near copies makes links in proportion to n.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import binary, drop_saved, saved, slices
from tidemark.llm.components import components

BITS = 64
RADIUS = 3
#: Fingerprints that have their own prefix in one bucket, on average; their variants are some 561 times as many.
BUCKET = 1024
#: Stands for a null id: after all others.
LAST = (1 << 63) - 1
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Fingerprints that a text has for its near copies, one more that checks pairs, and turns, one for each half of a fingerprint.
PRINTS = 32
TURNS = 2 * PRINTS
#: Leading bits of a half that near copies share, and bits that differ by ``RADIUS`` at most.
SHARED, BALL = 8, 24
#: Of the other half and the checking fingerprint, 96 bits, near copies differ in 15 on average and in more than these once in 30,000 pairs.
APART = 30
#: Members of a ball of which all pairs are checked; in larger ones all count as near the first.
CROWD = 32
#: Heads of a shingle in the last round that has some.
HEADS = 64
#: Links, of 16 bytes each, that one task connects.
FEW = 1 << 18


def shingle_hashes(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """Hashes of the word shingles, repeats included; fewer words than a shingle has are one shingle, no words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        return np.array([digest(join(words), seed)], np.uint64)
    runs = zip(*(words[i:] for i in range(shingle)), strict=False)
    return np.fromiter((digest(join(run), seed) for run in runs), np.uint64, len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; 0 without any."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK]
        ones += np.add.reduce(np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp: the fingerprint's bits as a signed 64-bit integer. Null texts count as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle, seed) for t in binary(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def prefixes(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, prefix) for each prefix that the row's variants have."""
    own = (prints >> np.uint64(BITS - bits)).astype(np.int64) if bits else np.zeros(len(prints), np.int64)
    rows = np.arange(len(prints))
    found = [(rows, own)]
    for i in range(bits):
        found.append((rows, own ^ (1 << i)))
        for j in range(i):
            both = (1 << i) | (1 << j)
            at = np.flatnonzero(own & both == both)
            found.append((at, own[at] ^ both))
    return np.concatenate([r for r, _ in found]), np.concatenate([p for _, p in found])


def variants(prints: np.ndarray, prefix: int, bits: int, width: int = BITS) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Near and far variants with that prefix, each with the rows they are of, of fingerprints of so many bits."""
    low = width - bits
    gap = (prints >> np.uint64(low)).astype(np.int64) ^ prefix if bits else np.zeros(len(prints), np.int64)
    weight = np.bitwise_count(gap)
    home, next_, apart = (np.flatnonzero(weight == k) for k in range(3))
    flips = np.uint64(1) << np.arange(low, dtype=np.uint64)
    lift = lambda rows: (gap[rows].astype(np.uint64) << np.uint64(low)) if bits else np.zeros(len(rows), np.uint64)
    near = [(prints[home], home), ((prints[home, None] ^ flips).ravel(), np.repeat(home, low)), (prints[next_] ^ lift(next_), next_)]
    far = []
    ones = (prints[home, None] & flips) != 0
    for i in range(1, low):
        at, j = np.nonzero(ones[:, :i] & ones[:, i, None])
        far.append((prints[home[at]] ^ flips[i] ^ flips[j], home[at]))
    cleared = next_[(prints[next_] & lift(next_)) != 0]
    at, j = np.nonzero((prints[cleared, None] & flips) != 0)
    far.append((prints[cleared[at]] ^ lift(cleared[at]) ^ flips[j], cleared[at]))
    far.append((prints[apart] ^ lift(apart), apart))
    return tuple(tuple(np.concatenate(x) for x in zip(*side, strict=True)) for side in (near, far))


def meet(prints: np.ndarray, prefix: int, bits: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Rows linked to rows: for each variant that is near to some, all that have it are linked to one of them."""
    (value, row), (far_value, far_row) = variants(prints, prefix, bits)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
    heads, keys = row[first], value[first]
    group = np.cumsum(np.r_[False, value[1:] != value[:-1]]) if len(value) else first
    at = np.searchsorted(keys, far_value)
    hit = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == far_value)) if len(keys) else np.zeros(0, np.int64)
    a, b = np.concatenate([row, far_row[hit]]), np.concatenate([heads[group], heads[at[hit]]])
    kept = (a != b) & (np.bitwise_count(prints[a] ^ prints[b]) <= radius)
    pairs = np.unique(np.stack([np.maximum(a, b)[kept], np.minimum(a, b)[kept]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row reachable of each of n rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def links(nodes: DataFrame, bits: int) -> DataFrame:
    """a, b: pairs of nodes (first_id, fp) within three bits, enough of them to connect all that are linked."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            rows, prefix = prefixes(prints.view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(ids[rows]), pa.array(prints[rows])], ["prefix", "first_id", "fp"])

    def collide(group: pa.Table) -> pa.Table:
        ids, prints = group.column("first_id").to_numpy(), group.column("fp").to_numpy()
        order = np.lexsort((prints, ids))
        ids, prints = ids[order], prints[order]
        a, b = meet(prints.view(np.uint64), int(group.column("prefix")[0].as_py()), bits)
        root = forest(len(prints), a, b)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a_id": ids[moved], "a_fp": prints[moved], "b_id": ids[root[moved]], "b_fp": prints[root[moved]]})

    dealt = nodes.select("first_id", "fp").mapInArrow(deal, "prefix long, first_id long, fp long")
    found = dealt.groupBy("prefix").applyInArrow(collide, "a_id long, a_fp long, b_id long, b_fp long")
    return found.select(*(F.struct(F.col(f"{x}_id").alias("first_id"), F.col(f"{x}_fp").alias("fp")).alias(x) for x in "ab"))


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint, component_id and fp for every row.

    ``fingerprint`` is 16 hexadecimal digits; ``component_id`` is the smallest doc_id reachable over links of at
    most three differing bits, the document itself included. Rows with the same id are rows of their own and
    both are returned; a null id never is a component's id unless no document in it has one. Null texts count as
    empty; texts without words have fingerprint zero and are linked like any other; texts of any length are taken
    whole. Equal texts have equal fingerprints, so ties have one result. Other columns are ignored, whatever their
    names. A table without rows gives none.

    A node is a fingerprint with the smallest id that has it, so that a component's smallest node names its id and no
    group ever meets under its root.
    """
    prints = saved(fingerprints(docs, shingle, seed))
    nodes = saved(prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(LAST)).alias("first_id")))
    bits = max(0, (nodes.count() // BUCKET).bit_length())
    roots = components(links(nodes, bits))
    rooted = nodes.select("fp", "first_id", F.struct("first_id", "fp").alias("own")).join(roots, F.col("own") == F.col("node"), "left")
    component = F.coalesce(F.col("root.first_id"), F.col("first_id"))
    of = saved(rooted.select(F.col("fp").alias("node_fp"), F.when(component != LAST, component).alias("component_id")))
    for used in (roots, nodes):
        drop_saved(used)
    return prints.join(of, prints["fp"] == of["node_fp"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp"
    )


def sketch(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One fingerprint of the hashes as each seed mixes them: bits set in over half of them."""
    ones = np.zeros(len(seeds) * BITS, np.int64)
    for at in range(0, len(hashes), 255):  # so that counts fit a byte
        mixed = (hashes[at : at + 255, None] ^ seeds) * (seeds | np.uint64(1))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def close(prints: np.ndarray, check: np.ndarray, odd: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose halves share the leading bits and a ball and whose other bits are near, enough to connect all such pairs.

    In a ball of over ``CROWD`` rows, which are no chance meetings, all count as near its first, so that a crowd has
    links in proportion to its size; what they connect beyond near pairs is for the exact check to tell.
    """
    low = np.uint64((1 << 32) - 1)
    own, other = (prints >> np.uint64(32), prints & low) if odd else (prints & low, prints >> np.uint64(32))
    lead = own & ~np.uint64((1 << BALL) - 1)
    (value, row), (far_value, far_row) = variants(own ^ lead, 0, 0, BALL)
    value, far_value = value | lead[row], far_value | lead[far_row]
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    sizes = np.diff(np.r_[first, len(value)])
    at = np.minimum(np.searchsorted(value[first], far_value), len(first) - 1)
    hit = np.flatnonzero(value[first][at] == far_value)
    member = np.concatenate([row, far_row[hit]])
    ball = np.concatenate([np.repeat(np.arange(len(first)), sizes), at[hit]])
    crowded = sizes[ball] > CROWD
    a, b = [member[crowded]], [row[first[ball[crowded]]]]
    member, ball = member[~crowded], ball[~crowded]
    for k in range(CROWD):
        kept = sizes[ball] > k
        member, ball = member[kept], ball[kept]
        x, y = member, row[first[ball] + k]
        gap = np.bitwise_count(other[x] ^ other[y]).astype(np.int64) + np.bitwise_count(check[x] ^ check[y])
        kept = (x != y) & (gap <= APART)
        a.append(x[kept])
        b.append(y[kept])
    return np.concatenate(a), np.concatenate(b)


def candidates(prints: DataFrame, bits: int) -> DataFrame:
    """a, b: pairs of nodes, enough to connect all whose fingerprints meet in a turn; ``prints`` has node and prints, dealt by so many of the shared bits."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            all_ = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, PRINTS + 1)
            for turn in range(TURNS):
                own = all_[:, turn // 2]
                lead = (own >> np.uint64(32 * (turn % 2) + 32 - bits)) & np.uint64((1 << bits) - 1)
                key = pa.array((lead.astype(np.int32) * TURNS + turn).astype(np.int32))
                yield pa.RecordBatch.from_arrays([key, pa.array(nodes), pa.array(own.view(np.int64)), pa.array(all_[:, PRINTS].view(np.int64))], ["key", "node", "print", "check"])

    def collide(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_numpy()
        order = np.argsort(nodes)
        nodes = nodes[order]
        own, check = (group.column(c).to_numpy()[order].view(np.uint64) for c in ("print", "check"))
        root = forest(len(nodes), *close(own, check, bool(group.column("key")[0].as_py() % TURNS % 2)))
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": nodes[moved], "b": nodes[root[moved]]})

    return prints.select("node", "prints").mapInArrow(deal, "key int, node long, print long, check long").groupBy("key").applyInArrow(collide, "a long, b long")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b of nodes whose sets of shingles are at least so similar, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.intersect1d(x, y, assume_unique=True).size
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def connect(links: DataFrame, few: int = FEW) -> DataFrame:
    """node, root of each node but roots, as ``components`` gives them, of links a, b of numbers.

    Up to ``few`` links, repeated ones counted once, go to one task: rounds of stars are some thirty stages, whose tasks
    and plans the driver keeps track of, and near copies are connected again and again. More links take the rounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate(x) for x in zip(*((c.to_numpy() for c in batch.columns) for batch in batches), strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = forest(len(nodes), at[: len(a)], at[len(a) :])
        moved = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["node", "root"])

    once = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    n = once.count()
    roots = saved(once.coalesce(1).mapInArrow(run, "node long, root long")) if 0 < n <= few else components(once)
    drop_saved(once)
    return roots


def rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes, whatever their columns, with the root that links give each."""
    roots = connect(links)
    found = saved(nodes.join(roots.select(F.col("node").alias("n"), "root"), F.col("node") == F.col("n"), "left").drop("n").withColumn("root", F.coalesce("root", "node")))
    drop_saved(roots)
    return found


def connected(members: DataFrame, direct: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links of so similar sets in a cluster, enough to connect all there are; ``members`` has cluster and node, ``direct`` the links known.

    Of two sets so similar, with their shingles in one order, the first common one stands so early in both that enough
    may follow it. The order has those first that fewest members have, so that a passage of many texts brings two
    together only if it is nearly all of both. Of those that have a shingle early the largest connected part gives heads, four
    times as many each round, which the others are held against; what that connects needs no more. When a round links none
    or has ``HEADS``, all pairs of different roots are held against each other.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            each = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            sizes = np.array([len(x) for x in each], np.int64)
            at = np.repeat(np.arange(len(each)), sizes)
            columns = [*(batch.column(k).take(pa.array(at)) for k in range(2)), pa.array(np.concatenate(each)), pa.array(sizes[at])]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "node", "shingle", "size"])

    def pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
        """Pairs of the structs, of different roots, that may be so similar by their sizes and the place of the shingle."""
        follow = F.least(F.col(f"{x}.size") - F.col(f"{x}.place"), F.col(f"{y}.size") - F.col(f"{y}.place"))
        enough = follow + 1e-6 >= (F.col(f"{x}.size") + F.col(f"{y}.size")) * (similarity / (1 + similarity))
        return rows.where((F.col(f"{x}.root") != F.col(f"{y}.root")) & enough).select(F.greatest(f"{x}.node", f"{y}.node").alias("a"), F.least(f"{x}.node", f"{y}.node").alias("b")).distinct()

    placed = rooted(members, direct)
    mixed = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    apart = placed.join(mixed.where("n > 2 and low != high").select("cluster"), "cluster")  # two have met
    tokens = saved(apart.join(sets, "node").select("cluster", "node", "shingles").mapInArrow(split, "cluster long, node long, shingle long, size long"))
    counts = tokens.groupBy("cluster", "shingle").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "shingle")) - 1  # of the shingle in its set
    early = tokens.join(counts, ["cluster", "shingle"]).withColumn("place", place)
    early = saved(early.where((F.col("n") > 1) & (F.col("place") <= F.col("size") * (1 - similarity) + 1e-6)).drop("n"))
    links, heads, last = [direct], 1, False
    first = F.col("own.place") <= F.col("own.size") * ((1 - similarity) / (1 + similarity))  # early enough for sets of one size
    while True:
        own = F.struct("node", "root", "size", "place")
        rows = early.join(placed.select("node", "root"), "node").select("cluster", "shingle", "root", own.alias("own"))
        parts = rows.groupBy("cluster", "shingle", "root").agg(F.count("*").alias("n")).groupBy("cluster", "shingle").agg(F.count("*").alias("parts"), F.max(F.struct("n", "root"))["root"].alias("main"))
        rows = saved(rows.join(parts.where("parts > 1").drop("parts"), ["cluster", "shingle"]))
        if last:
            others = rows
        else:
            draw = F.row_number().over(Window.partitionBy("cluster", "shingle").orderBy(first.desc(), F.xxhash64("own.node", "shingle", F.lit(heads))))
            others = rows.where("root = main").withColumn("draw", draw).where(F.col("draw") <= heads)
        held = pairs((rows if last else rows.where("root != main")).join(others.select("cluster", "shingle", F.col("own").alias("other")), ["cluster", "shingle"]), "own", "other")
        held = saved(held)
        links.append(saved(similar(held, sets, similarity)))
        ended, last, heads = last, heads >= HEADS or links[-1].isEmpty(), heads * 4
        for used in (held, rows, placed):
            drop_saved(used)
        if ended:
            break
        placed = rooted(members, reduce(DataFrame.union, links))
    found = saved(reduce(DataFrame.union, links))
    for used in (*links, early, tokens):
        drop_saved(used)
    return found


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, seed: int = 42, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, component_id, original and the columns to keep of every row, over links between texts whose word shingles are that similar.

    Similarity is the share of common shingles in all shingles of two texts. At 0.8 about ten of a fingerprint's 64 bits
    differ, so a text has ``PRINTS`` fingerprints, and of each half is a turn: two texts meet if the half's leading bits
    are equal and the others in one ball of ``RADIUS``. At 0.8 a turn finds 13 % of the pairs of long texts and all turns
    miss one of 9,700, by calculation; other bits keep chance meetings out. What meets, over any number of texts, is a
    cluster, in which links are exact and none is missed (``connected``). Texts with the same shingles are one node.

    ``original`` is true for one row of each group, that with the smallest doc_id, null last; of several such rows one.
    Rows are told apart by themselves, not by ids: ids may be null or repeat. Null and empty texts have no shingles and
    are copies of each other; texts of any length are taken whole; other columns are ignored, whatever their names;
    those to keep must not have a name of the result's. No rows give none.
    """
    seeds = np.random.default_rng(seed).integers(1 << 63, size=PRINTS + 1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle, seed)) for t in binary(batch.column(batch.num_columns - 1))]
            nodes = [xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets]
            prints = [sketch(s, seeds).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(np.array(nodes, np.uint64).view(np.int64)),
                    pa.array(prints, pa.list_(pa.int64())),
                    batch.column(batch.num_columns - 1),
                ],
                [*batch.schema.names[:-1], "node", "prints", "whole"],
            )

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(shingle_hashes(t, shingle, seed)).tobytes() for t in binary(batch.column(1))], pa.binary())], ["node", "shingles"])

    rows = docs.select(*(c for c in keep if c != "text"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("whole"))
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    # a row's number is stored with it, so that it is the same whoever reads it
    prints = saved(rows.mapInArrow(run, f"{kept}node long, prints array<long>, whole string").withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.col("row"))).alias("first")
    nodes = saved(prints.groupBy("node").agg(first))
    each = saved(prints.join(nodes.select(F.col("first.row").alias("row")), "row", "left_semi").select("node", "prints"))
    met = connect(candidates(each, min(SHARED, (nodes.count() // (8 * BUCKET)).bit_length())))
    members = saved(met.select("node", F.col("root").alias("cluster")).union(met.select("root", "root").distinct()))
    # one text of each such node, by its first row; shingles take more room than texts, so only these are written
    firsts = nodes.join(members, "node", "left_semi").select(F.col("first.row").alias("row"))
    sets = saved(prints.join(firsts, "row", "left_semi").select("node", "whole").mapInArrow(shingles, "node long, shingles binary"))
    direct = saved(similar(met.select(F.col("node").alias("a"), F.col("root").alias("b")), sets, similarity))
    links = connected(members, direct, sets, similarity)
    first_of = lambda x: nodes.select(F.col("node").alias(x), F.struct("first", "node").alias(f"{x}_node"))
    named = links.join(first_of("a"), "a").join(first_of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    of = components(named)  # nodes by their first rows: a component's smallest node names its first row
    own = nodes.select(F.struct("first", "node").alias("own"), "node").join(of.withColumnRenamed("node", "linked"), F.col("own") == F.col("linked"), "left")
    found = saved(own.select(F.col("node").alias("n"), F.coalesce("root.first", "own.first").alias("first")))
    for used in (of, links, sets, members, met, each, nodes):
        drop_saved(used)
    whole = {"text": F.col("whole").alias("text")}  # a column to keep that is written already
    named = prints.drop("prints").join(found, F.col("node") == F.col("n"))
    component = F.when(F.col("first.id") != LAST, F.col("first.id")).alias("component_id")
    return named.select(*(whole.get(c, F.col(c)) for c in keep), "doc_id", component, (F.col("row") == F.col("first.row")).alias("original"))
