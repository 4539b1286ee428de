"""Removing repeated passages by longest-previous-factor arrays.

A passage of ``least`` bytes that an earlier document has is removed from every later one. Documents are
ordered by id; a position's previous factor is the longest match that starts in a document with a smaller id,
and the nearest smaller documents before and after it in suffix order give it.

The suffix array is distributed. Windows of ``least`` bytes that are equal have the same anchor (see
``anchors``), so they meet in the bucket of the anchor's key, and each bucket sorts its own suffixes:

1. keys are counted; those of one document only cannot repeat and go no further,
2. every other anchor sends the run of bytes that its windows span to the key's bucket,
3. a bucket sorts the suffixes of its runs and finds their previous factors by the nearest smaller documents on
   either side; what they cover goes back to the documents and is cut out.

Of equal runs, their bytes compared, a bucket sorts those of the two smallest documents: what is covered of the
second is covered of all later ones. Before the shuffle a task merges equal runs of its own in the same way: the
earliest one stays and is a previous factor of the others, so that what a third of all documents share sends an
entry for each task and not for each document. Runs of the most frequent keys are cut into their windows, which are
dealt by content.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.anchors import KEY_MASK, anchors
from tidemark.llm.common import binary, partitions, saved

GRAM = 24
#: Anchors that a task merges at once.
BLOCK = 1_500_000
#: Bytes of input, as stored, that a bucket is worth at least, and at most.
BUCKET_BYTES, FULL_BYTES = 1 << 20, 1 << 25
#: Runs of a key are cut into windows if it is in so many documents and in one of so many of all entries. So there are
#: ``HOT_KEYS`` such keys at most, and any other key has less than that part of the work.
HOT_DOCS, HOT_KEYS = 1_000, 100_000
#: Bytes of text whose runs are made at once, and suffixes that are sorted at once.
TEXT_BYTES, SUFFIXES = 1 << 23, 1 << 20
LAST = (1 << 63) - 1
SCHEMA = "kind int, dest long, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length in one compressed string: 64-bit numbers as differences, in planes of bytes."""
    head = [np.int64(len(arrays[0])).tobytes()]
    body = []
    for a in arrays:
        head.append(a.dtype.str[1:].encode() + (a.shape[1] if a.ndim > 1 else 0).to_bytes(2, "little"))
        if a.itemsize == 8:
            a = np.diff(a, prepend=a.dtype.type(0)).view(np.uint8).reshape(-1, 8).T
        body.append(np.ascontiguousarray(a).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*head, b";", *body]))


def unpack(blob: bytes) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    kinds, at = [], 8
    while body[at : at + 1] != b";":
        kinds.append((np.dtype(body[at : at + 2].decode()), int.from_bytes(body[at + 2 : at + 4], "little")))
        at += 4
    at, out = at + 1, []
    for kind, wide in kinds:
        if kind.itemsize == 8:
            planes = np.frombuffer(body, np.uint8, 8 * n, at).reshape(8, n)
            a = np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)
        else:
            a = np.frombuffer(body, kind, n * max(1, wide), at)
            a = a.reshape(n, wide) if wide else a
        at += a.nbytes
        out.append(a)
    return out


def gather(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True)]


def home(doc: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    mixed = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return bucket_of(mixed ^ (mixed >> np.uint64(32)), buckets)


def bucket_of(key: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return buckets[(key % np.uint64(len(buckets))).astype(np.int64)]


def even_buckets(docs: DataFrame) -> np.ndarray:
    """Numbers of buckets that hashing deals evenly to shuffle partitions.

    There are as many as shuffle partitions, or fewer where the input, by the optimizer's estimate of its size, is
    small for them: every task sends each bucket a string, and small input cut fine would be mostly strings. On large
    input with few partitions each has several, which are worked on one after the other, so that memory is bounded.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    several = 1 if size >= 1 << 60 else max(1, -(-size // (FULL_BYTES * n)))  # without any estimate sizes are huge
    numbers = spark.range(n * (12 + n.bit_length()) * several).select("id", F.expr(f"pmod(hash(id), {n})").alias("p"))
    found = [i for r in numbers.groupBy("p").agg(F.array_sort(F.collect_list("id")).alias("ids")).collect() for i in r["ids"][:several]]
    return np.sort(np.array(found, np.int64))[: max(1, -(-size // BUCKET_BYTES))]


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "dest", "blob"]
    )


def dealt(kind: int, dest: np.ndarray, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
    """A blob for each destination."""
    order = np.argsort(dest, kind="stable")
    dest = dest[order]
    cuts = groups(dest)
    if not len(cuts):
        return []
    return [(kind, int(dest[a]), pack(*(x[order[a:b]] for x in arrays))) for a, b in zip(cuts, np.r_[cuts[1:], len(dest)], strict=True)]


def groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def count_keys(texts: list[bytes], docs: np.ndarray, least: int, buckets: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Kind 0: (key, document, log2 of its documents here) to the key's bucket; kind 1: (document, key) to the document's home."""
    found = list(anchors(texts, least, GRAM))
    if not found:
        return []
    row, key = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    doc = docs[row]
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    once = groups(key, doc)
    key, doc = key[once], doc[once]
    start = groups(key)
    n = np.diff(np.r_[start, len(key)])
    many = np.repeat(n > 1, n)
    weight = np.where(n > 1, np.maximum(1, np.log2(n)), 0).astype(np.uint8)
    one = start[np.argsort(doc[start], kind="stable")]  # in the order of documents, whose differences then compress
    weight = np.repeat(weight, n)[one]
    every = np.flatnonzero(many)
    every = every[np.argsort(doc[every], kind="stable")]
    out = dealt(0, bucket_of(key[one], buckets), key[one], doc[one], weight)
    return out + dealt(1, home(doc[every], buckets), doc[every], key[every])


def match_keys(blobs: list[bytes], buckets: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Kind 1: (document, key) of what other tasks have too; kind 2: (key, documents) of frequent keys; kind 3: entries in all."""
    key, doc, weight = gather(blobs)
    order = np.argsort(key, kind="stable")
    key, doc, weight = key[order], doc[order], weight[order]
    start = groups(key)
    n = np.diff(np.r_[start, len(key)])
    low, high = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
    several = (low != high) | (np.maximum.reduceat(weight, start) > 0)
    total = np.add.reduceat(np.left_shift(np.int64(1), weight.astype(np.int64)), start)
    told = np.repeat(several, n) & (weight == 0)
    to = np.flatnonzero(told)
    to = to[np.argsort(doc[to], kind="stable")]
    out = dealt(1, home(doc[to], buckets), doc[to], key[to])
    hot = total >= HOT_DOCS
    if hot.any():
        out.append((2, 0, pack(key[start][hot], total[hot])))
    out.append((3, 0, int(total.sum()).to_bytes(8, "little")))
    return out


def pair_of(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A hash of document and key; equal ones only let a run through that need not go."""
    return doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ key


def runs_of(texts: list[bytes], docs: np.ndarray, tags: np.ndarray, pairs: np.ndarray, hot: np.ndarray, least: int, buckets: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Kind 0: runs of bytes to their buckets; kind 1: spans that an equal run of an earlier document here covers. ``pairs`` are sorted."""
    at = [i for i, t in enumerate(texts) if len(t) >= least]
    found = list(anchors([texts[i] for i in at], least, GRAM))
    if not found or not len(pairs):
        return []
    row, key, first, last = (np.concatenate([f[i] for f in found]) for i in (0, 1, 3, 4))
    row = np.array(at, np.int64)[row]
    pair = pair_of(docs[row], key)
    kept = np.flatnonzero(pairs[np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)] == pair)
    row, key, first, last = (a[kept] for a in (row, key, first, last))
    if len(hot) and len(key):
        often = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        cut = np.flatnonzero(often)
        times = (last - first + 1)[cut]
        each = np.repeat(first[cut], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        own = np.flatnonzero(~often)
        row = np.r_[row[own], np.repeat(row[cut], times)]
        first, last = np.r_[first[own], each], np.r_[last[own], each]
        key = np.r_[key[own], np.zeros(len(each), np.uint64)]
        whole = np.r_[np.zeros(len(own), bool), np.ones(len(each), bool)]
    else:
        whole = np.zeros(len(key), bool)
    if not len(row):
        return []
    size = (last - first + least).astype(np.uint16)
    runs = run_bytes(texts, row, first, size, 2 * least - GRAM)
    doc, tag = docs[row], tags[row]
    if whole.any():
        key[whole] = row_hash(runs[whole], 1) & KEY_MASK
    start, order = equal_runs(runs, size, doc, key)
    runs, key, size, doc, tag, first = (a[order] for a in (runs, key, size, doc, tag, first))
    later = doc > np.repeat(doc[start], np.diff(np.r_[start, len(doc)]))
    out = dealt(1, home(doc[later], buckets), doc[later], tag[later], first[later], first[later] + size[later])
    sent = np.flatnonzero(~later)
    sent = sent[np.argsort(doc[sent], kind="stable")]
    part = ((key >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out + dealt(0, bucket_of(key[sent], buckets), runs[sent], size[sent], part[sent], doc[sent], tag[sent], first[sent])


def equal_runs(runs: np.ndarray, size: np.ndarray, doc: np.ndarray, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of groups of equal runs in an order, and the order, in which each group's documents go up.

    Hashes bring equal runs together; that they are equal is told by their bytes.
    """
    own = row_hash(runs) ^ size.astype(np.uint64)
    order = np.lexsort((doc, own)) if key is None else np.lexsort((doc, own, key))
    new = np.ones(len(order), bool)
    new[1:] = (size[order[1:]] != size[order[:-1]]) | (own[order[1:]] != own[order[:-1]])
    same = np.flatnonzero(~new)
    for at in range(0, len(same), 1 << 16):
        few = same[at : at + (1 << 16)]
        new[few] = (runs[order[few]] != runs[order[few - 1]]).any(axis=1)
    return np.flatnonzero(new), order


def run_bytes(texts: list[bytes], row: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The runs as rows of a matrix, filled up with zeros."""
    data = np.frombuffer(b"".join(texts) + bytes(width), np.uint8)
    base = np.cumsum([0, *map(len, texts)])
    runs = np.lib.stride_tricks.sliding_window_view(data, width)[base[row] + first].copy()
    runs[np.arange(width) >= size[:, None]] = 0
    return runs


def row_hash(rows: np.ndarray, seed: int = 0) -> np.ndarray:
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    words = padded.view(np.uint64)
    mixed = np.full(len(rows), 0x27D4EB2F165667C5 + seed, np.uint64)
    for k in range(words.shape[1]):
        mixed = (mixed ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed ^ (mixed >> np.uint64(32))


def previous_factors(words: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each suffix the length, up to ``least``, of its longest match with a suffix of a smaller document.

    ``words`` has the first ``least`` bytes as big-endian numbers, the last one cut. The nearest suffixes with a
    smaller document on either side in suffix order hold the longest match; each is reached by following the
    links of those passed over, with the least common prefix on the way. Ways along which less than ``least``
    bytes are common end there, so that a length below ``least`` is a lower bound.
    """
    n = len(doc)
    order = np.lexsort((doc, *words.T[::-1]))
    rank = doc[order]
    lcp = np.zeros(n + 1, np.int64)  # of a suffix and the one before
    undecided = np.arange(1, n)
    for k in range(words.shape[1]):
        if not len(undecided):
            break
        apart = words[order[undecided], k] ^ words[order[undecided - 1], k]
        equal = apart == 0
        lcp[undecided] += np.where(equal, 8, (63 - np.floor(np.log2(np.maximum(apart, 1).astype(np.float64)))).astype(np.int64) // 8)
        undecided = undecided[equal]
    lcp = np.minimum(lcp, least)
    best = np.zeros(n, np.int64)
    for side in (-1, 1):
        link = np.arange(n) + side
        common = lcp[:n].copy() if side < 0 else lcp[1:].copy()
        open_ = np.arange(n)
        while len(open_):
            to = link[open_]
            open_ = open_[(to >= 0) & (to < n) & (common[open_] >= least)]
            to = link[open_]
            on = rank[to] >= rank[open_]
            open_, to = open_[on], to[on]
            common[open_] = np.minimum(common[open_], common[to])
            link[open_] = link[to]
        hit = (link >= 0) & (link < n)
        hit[hit] &= rank[link[hit]] < rank[hit]
        best = np.where(hit, np.maximum(best, common), best)
    out = np.zeros(n, np.int64)
    out[order] = best
    return out


def find_spans(blobs: list[bytes], least: int, buckets: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Kind 1: (document, tag, start, end) of what an earlier document covers, by the suffixes of all runs.

    Equal windows have equal keys, so parts of the keys are sorted one after the other.
    """
    runs, size, part, doc, tag, first = gather(blobs)
    order = np.argsort(part, kind="stable")
    times = np.cumsum((size[order].astype(np.int64) - least + 1))
    start = groups(part[order])
    out, at = [], 0
    while at < len(start):
        low = times[start[at] - 1] if start[at] else 0
        end = max(at + 1, int(np.searchsorted(times[np.r_[start[1:], len(order)] - 1], low + SUFFIXES, "right")))
        mine = order[start[at] : start[end] if end < len(start) else len(order)]
        out.append(covered(runs[mine], size[mine], doc[mine], least) + (mine,))
        at = end
    who = np.concatenate([m[w] for w, _, _, m in out])
    begin, stop = (np.concatenate([o[k] for o in out]) for k in (1, 2))
    to = np.argsort(doc[who], kind="stable")
    who, begin, stop = who[to], begin[to], stop[to]
    return dealt(1, home(doc[who], buckets), doc[who], tag[who], first[who] + begin, first[who] + stop)


def covered(runs: np.ndarray, size: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, begin, end): the maximal parts of runs that previous factors of ``least`` bytes cover."""
    start, order = equal_runs(runs, size, doc)
    n = np.diff(np.r_[start, len(order)])
    group = np.repeat(np.arange(len(start)), n)
    lowest = doc[order[start]]
    later = np.flatnonzero(doc[order] > lowest[group])  # in the order of groups and documents
    second = later[np.r_[True, group[later][1:] != group[later][:-1]]] if len(later) else later
    chosen = order[np.r_[start, second]]  # of each group the smallest document's run and the next one's
    wide = runs.shape[1]
    times = size[chosen].astype(np.int64) - least + 1
    owner = np.repeat(np.arange(len(chosen)), times)
    offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    stride = wide + 8
    flat = np.zeros(len(chosen) * stride + 16, np.uint8)
    flat[: len(chosen) * stride].reshape(len(chosen), stride)[:, :wide] = runs[chosen]
    eight = np.ndarray((len(flat) - 8,), ">u8", flat, strides=(1,))
    words = np.stack([eight[owner * stride + offset + k].astype(np.uint64) for k in range(0, least, 8)], 1)
    if least % 8:
        words[:, -1] &= ~np.uint64((1 << (8 * (8 - least % 8))) - 1)
    hit = np.flatnonzero(previous_factors(words, doc[chosen][owner], least) >= least)
    if not len(hit):
        return (np.zeros(0, np.int64),) * 3
    new = np.flatnonzero(np.r_[True, (owner[hit][1:] != owner[hit][:-1]) | (offset[hit][1:] > offset[hit][:-1] + least)])
    who, begin, end = owner[hit][new], offset[hit][new], offset[hit][np.r_[new[1:], len(hit)] - 1] + least
    # rows of a chosen run: those of its group with its document, and for the second one all later ones
    low = np.r_[start, second]
    high = np.r_[start, second]
    count_low = np.bincount(group[np.flatnonzero(doc[order] == lowest[group])], minlength=len(start))
    high[: len(start)] += count_low
    high[len(start) :] = (start + n)[group[second]]
    k = (high - low)[who]
    rows = np.repeat(low[who], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    return order[rows], np.repeat(begin, k), np.repeat(end, k)


def repeats(docs: DataFrame, least: int = 50, keep: Sequence[str] = ()) -> DataFrame:
    """The columns to keep, doc_id, n_bytes, n_removed, spans (start, end of the removed bytes), kept (the bytes that stay), text of every row.

    ``text`` is what stays, less the bytes of characters that were cut in two.

    Texts are taken as UTF-8 bytes, null as none, and matches never cross documents. A null id comes after all
    others. Rows with the same id, null included, do not remove each other's passages; they are told apart by hashes
    of their texts (64 bits for null ids, 32 for others), and repeated rows lose the same bytes each. Texts under
    ``least`` bytes keep all, texts of any length are taken whole; a table without rows gives none. Other columns
    than those to keep are ignored, whatever their names; those to keep must not have a name of the result's.
    """
    if not GRAM < least < 1 << 14:
        raise ValueError(f"least is {GRAM + 1} to {(1 << 14) - 1} bytes")
    spark = docs.sparkSession
    buckets = even_buckets(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole = docs.select(*(F.col(c) for c in keep), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in whole.schema.fields[:-2])

    def ids(column: pa.Array) -> np.ndarray:
        return column.fill_null(LAST).to_numpy(zero_copy_only=False)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            *others, doc_id, text = batch.columns
            z = pa.array([squeeze(t or b"") for t in binary(text)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(home(ids(doc_id), buckets)), *others, doc_id, z], ["dest", *keep, "doc_id", "z"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        doc: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                new = [t or b"" for t in binary(part.column(1))]
                texts += new
                doc.append(ids(part.column(0)))
                held += sum(map(len, new))
                if held > BLOCK * (least - GRAM) // 2:
                    yield batch_of(count_keys(texts, np.concatenate(doc), least, buckets))
                    texts, doc, held = [], [], 0
        if texts:
            yield batch_of(count_keys(texts, np.concatenate(doc), least, buckets))

    def buckets_of(df: DataFrame, work) -> DataFrame:
        """Each bucket's blobs of kind 0 go to ``work``, one bucket at a time; other kinds pass."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blobs: list[bytes] = []
            bucket = None
            for batch in batches:
                kinds, dests = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                if (kinds != 0).any():
                    yield batch.filter(pa.array(kinds != 0))
                mine = np.flatnonzero(kinds == 0)
                for dest, blob in zip(dests[mine].tolist(), batch.column(2).take(pa.array(mine)).to_pylist(), strict=True):
                    if dest != bucket and blobs:
                        yield batch_of(work(blobs))
                        blobs = []
                    bucket = dest
                    blobs.append(blob)
            if blobs:
                yield batch_of(work(blobs))

        return df.repartition("dest").sortWithinPartitions("dest").mapInArrow(run, SCHEMA)

    def texts_of(table: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        expand = zstandard.ZstdDecompressor().decompress
        texts = [expand(z) for z in table.column("z").to_pylist()]
        doc = table.column("doc_id").combine_chunks().fill_null(LAST).to_numpy()
        tag = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64)
        return doc, texts, np.where(doc == LAST, tag, tag & np.uint64(0xFFFFFFFF)).view(np.int64)

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if left.num_rows and right.num_rows:
            pairs = distinct(pair_of(*gather(right.column("blob").to_pylist())))
            for at, end in pieces(left):
                doc, texts, tag = texts_of(left.slice(at, end - at))
                out += runs_of(texts, doc, tag, pairs, frequent.value, least, buckets)
        return pa.Table.from_batches([batch_of(out)])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, texts, tag = texts_of(left)
        spans = {}
        if right.num_rows:
            d, t, a, b = gather(right.column("blob").to_pylist())
            order = np.lexsort((a, t, d))
            d, t, a, b = d[order], t[order], a[order], b[order]
            start = groups(d, t)
            for i, j in zip(start.tolist(), np.r_[start[1:], len(d)].tolist(), strict=True):
                top = np.maximum.accumulate(b[i:j])
                new = np.flatnonzero(np.r_[True, a[i + 1 : j] > top[:-1]])
                spans[int(d[i]), int(t[i])] = list(zip(a[i:j][new].tolist(), top[np.r_[new[1:], j - i] - 1].tolist(), strict=True))
        own = [spans.get((int(i), int(t)), []) for i, t in zip(doc, tag, strict=True)]
        kept = [b"".join(x[a:b] for a, b in zip([0, *(e for _, e in s)], [*(b for b, _ in s), len(x)], strict=True)) for x, s in zip(texts, own, strict=True)]
        return pa.table(
            {
                **{c: left.column(c) for c in keep},
                "doc_id": left.column("doc_id"),
                "n_bytes": pa.array([len(x) for x in texts], pa.int64()),
                "n_removed": pa.array([len(x) - len(k) for x, k in zip(texts, kept, strict=True)], pa.int64()),
                "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in own], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(kept, pa.binary()),
                "text": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()),
            }
        )

    packed = whole.mapInArrow(compress, f"dest long, {kept}doc_id long, z binary")
    counted = saved(buckets_of(rows.mapInArrow(keys, SCHEMA), lambda b: match_keys(b, buckets)))
    total = sum(int.from_bytes(r["blob"], "little") for r in counted.where("kind = 3").select("blob").toLocalIterator())
    bound = max(HOT_DOCS, total // HOT_KEYS)

    def hottest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                key, n = unpack(blob)
                yield pa.RecordBatch.from_arrays([pa.array(key[n >= bound].view(np.int64))], ["key"])

    hot = [r["key"] for r in counted.where("kind = 2").select("blob").mapInArrow(hottest, "key long").toLocalIterator()]
    frequent = spark.sparkContext.broadcast(np.sort(np.array(hot, np.int64).view(np.uint64)))  # HOT_KEYS keys at most
    shared = counted.where("kind = 1").select("dest", "blob").groupBy("dest")
    runs = packed.groupBy("dest").cogroup(shared).applyInArrow(fetch, SCHEMA)
    spans = buckets_of(runs, lambda b: find_spans(b, least, buckets)).select("dest", "blob")
    return packed.groupBy("dest").cogroup(spans.groupBy("dest")).applyInArrow(
        cut, f"{kept}doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary, text string"
    )


def pieces(table: pa.Table) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``TEXT_BYTES`` of text each, or one row."""
    size = np.array([zstandard.frame_content_size(z) for z in table.column("z").to_pylist()], np.int64)
    at = held = 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > TEXT_BYTES:
            yield at, i
            at, held = i, 0
        held += n
    yield at, len(size)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values
