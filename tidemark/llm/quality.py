"""Quality classifier by co-training.

Two classifiers see a document from different sides: one its text (hashed words and the text's own figures), the
other the page's metadata (source, language and recorded length), never the text. Both are fitted to labelled
documents. In each round both score all documents without a label; a threshold that so many of all of them pass tells
whom a view is sure of, and of those each view gives the other some as pseudo-labels; then both are fitted again. At
the end each view is calibrated on labelled documents that fitting left out, and the calibrated views' log-odds, weighed
by a logistic curve, score every document.

Texts are read once: a document's features, some hundred bytes, are written as a table which all rounds and the
scoring read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import RANGE, rescale, sample, slices

#: Labelled documents of each label that a fit reads, about, at most.
SAMPLE_DOCS = 2_500
ROUNDS = 3
#: Documents without a label that a view is sure of, as a part of all, and how many of them it gives in a round, about, at most.
GIVEN, GIFTS = 0.05, 400
#: Bins of the scores by which the thresholds are found.
BINS = 4_096
WORDS = re.compile(r"\w+")
TEXT_BUCKETS, META_BUCKETS = 1 << 13, 1 << 10
#: One labelled document in so many is left out of fitting for the calibration.
HELD = 5


def _figures(values: list[float]) -> list[tuple[int, float]]:
    return [(i, v) for i, v in enumerate(values) if v]


class Buckets(dict):
    """The column of each word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = at = 16 + zlib.crc32(word.encode("utf-8", "surrogatepass")) % TEXT_BUCKETS
        return at


COLUMN = Buckets()


def text_features(text: str) -> dict[int, float]:
    """Figures of the whole text, then its words, hashed; a word counts by the logarithm of its part."""
    words = WORDS.findall(text.lower())
    n = max(1, len(words))
    counts = Counter(words)
    letters = sum(map(len, words))
    full = [line for line in text.split("\n") if line.strip()]
    k = max(1, len(full))
    figures = [
        1.0,
        math.log1p(len(words)) / 5,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        letters / n / 10,
        1 - letters / max(1, len(text)),
        sum(map(text.count, "|#$%*&<>{}")) / n,
        sum(map(text.count, ".,;:!?")) / n,
        sum(map(str.isdigit, counts)) / max(1, len(counts)),
        len(set(full)) / k,
        math.log1p(len(text) / k) / 5,
        sum(line.rstrip()[-1] in ".!?\"'" for line in full) / k,
        sum(len(line) < 30 for line in full) / k,
    ]
    out = dict(_figures(figures))
    logs = {c: 1 + math.log(c) for c in set(counts.values())}
    norm = math.sqrt(sum([logs[c] ** 2 for c in counts.values()])) or 1.0
    for word, c in counts.items():
        at = COLUMN[word]
        out[at] = out.get(at, 0.0) + logs[c] / norm
    return out


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> dict[int, float]:
    """Source, language and recorded length, hashed, alone and in pairs; length by its order of magnitude."""
    size = "none" if n_chars is None else str(int(2 * math.log2(1 + max(0, n_chars))))
    out = {0: 1.0}
    names = [f"source={source}", f"lang={lang}", f"size={size}"]
    for name in (*names, *(f"{a} {b}" for i, a in enumerate(names) for b in names[:i])):
        out[16 + zlib.crc32(name.encode("utf-8", "surrogatepass")) % META_BUCKETS] = 1.0
    return out


class Rows:
    """Sparse rows, from maps of column to value, as one array of columns and one of values."""

    def __init__(self, maps: pa.MapArray | pa.ChunkedArray):
        maps = maps.combine_chunks() if isinstance(maps, pa.ChunkedArray) else maps
        if not len(maps):
            self.size, self.column, self.value, self.row = (np.zeros(0, np.int64) for _ in range(4))
            return
        self.size = np.diff(maps.offsets.to_numpy())
        start, end = maps.offsets[0].as_py(), maps.offsets[-1].as_py()
        self.column = maps.keys.to_numpy()[start:end].astype(np.int64)
        self.value = maps.items.to_numpy()[start:end]
        self.row = np.repeat(np.arange(len(maps)), self.size)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.column], len(self.size))

    def back(self, x: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, self.value * x[self.row], width)


def logistic(rows: Rows, label: np.ndarray, weight: np.ndarray, start: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression, by gradient steps scaled by column (Adagrad). Labels weigh alike in sum."""
    w, seen = start.copy(), np.full(len(start), 1e-8)
    total = {y: max(1e-9, weight[label == y].sum()) for y in (0.0, 1.0)}
    pull = np.where(label > 0, weight / total[1.0], weight / total[0.0]) / 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows.times(w), -30, 30)))
        gradient = rows.back(pull * (p - label), len(w)) + ridge * w
        seen += gradient**2
        w -= 0.3 * gradient / np.sqrt(seen)
    return w


@dataclass
class QualityModel:
    text_weights: np.ndarray
    meta_weights: np.ndarray
    text_curve: tuple[float, float] = (1.0, 0.0)
    meta_curve: tuple[float, float] = (1.0, 0.0)
    mix: tuple[float, float] = (1.0, 0.0)

    def views(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds of either view."""
        (a, b), (c, d) = self.text_curve, self.meta_curve
        return a * text.times(self.text_weights) + b, c * meta.times(self.meta_weights) + d


def chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


FEATURES = "doc_id long, t map<int, float>, m map<int, float>"
_MAP = pa.map_(pa.int32(), pa.float32())


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of either view of every row; ``docs`` has doc_id, text, lang, source, n_chars."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")), F.col("n_chars").cast("long").alias("n_chars"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts, *meta = batch.columns
            t = pa.array([list(text_features(x or "").items()) for x in texts.to_pylist()], _MAP)
            m = pa.array([list(meta_features(*x).items()) for x in zip(*(c.to_pylist() for c in meta), strict=True)], _MAP)
            yield pa.RecordBatch.from_arrays([ids, t, m], ["doc_id", "t", "m"])

    return rows.mapInArrow(look, FEATURES)


def thresholds(seen: DataFrame, model: QualityModel, base: float) -> tuple[list[tuple[float, float]], list[tuple[float, float]]]:
    """For each view the scores below and above which it is sure of a document, and the parts of those to give.

    Scores of all rows of ``seen`` are counted in bins, which are combined before the shuffle.
    """
    low, high = -8.0, 8.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, BINS), np.int64)
        for batch in batches:
            for v, x in enumerate(_raw(batch, model)):
                found[v] += np.bincount(np.clip((x - low) / (high - low) * BINS, 0, BINS - 1).astype(np.int64), minlength=BINS)
        view, at = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(view.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(found[view, at])], ["view", "bin", "n"])

    counted = seen.select("t", "m").mapInArrow(count, "view int, bin int, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).collect()
    hist = np.zeros((2, BINS), np.int64)
    for r in counted:
        hist[r["view"], r["bin"]] = r["n"]
    edge = low + (high - low) * np.arange(BINS + 1) / BINS
    cuts, parts = [], []
    for v in (0, 1):
        up, down = np.cumsum(hist[v]), np.cumsum(hist[v][::-1])
        total = max(1, int(up[-1]))
        # the bin in which the wanted part is reached counts as a whole: ties are all sure
        i, j = int(np.searchsorted(up, GIVEN * (1 - base) * total)), int(np.searchsorted(down, GIVEN * base * total))
        cuts.append((float(edge[i + 1]), float(edge[BINS - 1 - j])))
        parts.append((min(1.0, GIFTS * (1 - base) / max(1, int(up[i]))), min(1.0, GIFTS * base / max(1, int(down[j])))))
    return cuts, parts


def _raw(batch: pa.RecordBatch, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    t, m = (Rows(batch.column(batch.schema.names.index(c))) for c in "tm")
    return t.times(model.text_weights), m.times(model.meta_weights)


def gifts(seen: DataFrame, known: DataFrame, model: QualityModel, base: float, turn: int) -> pa.Table:
    """t, m, view, label: about ``GIFTS`` documents that each view is sure of, drawn by hash out of all that it is sure of, less labelled ones."""
    cuts, parts = thresholds(seen, model, base)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(RANGE)) / float(RANGE)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lot = batch.column(2).to_numpy()
            ids = batch.column(3)
            for v, x in enumerate(_raw(batch, model)):
                (low, high), (few, many) = cuts[v], parts[v]
                for y, sure in ((0, (x < low) & (lot < few)), (1, (x >= high) & (lot < many))):
                    at = pa.array(np.flatnonzero(sure))
                    made = [ids.take(at), batch.column(0).take(at), batch.column(1).take(at), pa.array([v] * len(at), pa.int32()), pa.array([y] * len(at), pa.int32())]
                    yield pa.RecordBatch.from_arrays(made, ["doc_id", "t", "m", "view", "label"])

    found = seen.select("t", "m", draw.alias("lot"), "doc_id").mapInArrow(pick, "doc_id long, t map<int, float>, m map<int, float>, view int, label int").toArrow()
    ids = seen.sparkSession.createDataFrame([(i,) for i in set(found["doc_id"].to_pylist()) if i is not None], "doc_id long")
    labelled = known.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id").distinct().toArrow()["doc_id"]  # about 4 * GIFTS ids at most
    return found.filter(pa.compute.invert(pa.compute.is_in(found["doc_id"], labelled.combine_chunks()))).combine_chunks()


def fit(seen: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> QualityModel:
    """Learn from features of all documents and the labels (quality 1 or 0) of some; ``seen`` is read often, so a table.

    Of the labelled documents a sample, bounded for each label, is fitted to; all documents are scored in every round and
    those without a label may be given. The calibration weighs each label by the inverse of its sampled share.
    """
    known = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    few, share = sample(known, "quality", sample_docs)  # about sample_docs rows of either label
    found = seen.join(F.broadcast(few), "doc_id").select("doc_id", "quality", "t", "m").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    ids, label = found["doc_id"].to_numpy(), found["quality"].to_numpy().astype(float)
    held = np.array([zlib.crc32(str(i).encode()) % HELD == 1 for i in ids.tolist()], bool)
    widths = (16 + TEXT_BUCKETS, 16 + META_BUCKETS)
    model = QualityModel(*(np.zeros(w) for w in widths))
    own = found.filter(pa.array(~held)).select(["t", "m", "quality"]).rename_columns(["t", "m", "label"])
    y = own["label"].to_numpy().astype(float)
    if len(set(y.tolist())) == 2:
        weighed = {v: n / share[int(v)] for v, n in zip(*np.unique(label, return_counts=True), strict=True)}
        base = float(weighed[1.0] / sum(weighed.values()))
        taught: list[list[pa.Table]] = [[], []]  # by the view that learns
        for turn in range(rounds + 1):
            for v, name in ((0, "t"), (1, "m")):
                extra = [g.select([name, "label"]) for g in taught[v]]
                rows = pa.concat_tables([own.select([name, "label"]), *extra]).combine_chunks()
                pull = np.r_[np.ones(len(own)), np.full(len(rows) - len(own), 0.3)]  # pseudo-labels count for less
                old = model.text_weights if v == 0 else model.meta_weights
                new = logistic(Rows(rows[name]), rows["label"].to_numpy().astype(float), pull, old)
                if v == 0:
                    model.text_weights = new
                else:
                    model.meta_weights = new
            if turn < rounds:
                given = gifts(seen, known, model, base, turn)
                for v in (0, 1):
                    taught[1 - v].append(given.filter(pa.compute.equal(given["view"], v)).select(["t", "m", "label"]))
    left = found.filter(pa.array(held)).combine_chunks()
    truth = label[held]
    weight = np.array([1 / share[int(v)] for v in truth.tolist()])
    raw = (Rows(left["t"]).times(model.text_weights), Rows(left["m"]).times(model.meta_weights))
    curves = [rescale(x, truth, weight) for x in raw]
    both = sum(a * x + b for x, (a, b) in zip(raw, curves, strict=True)) if len(truth) else np.zeros(0)
    model.text_curve, model.meta_curve = curves
    model.mix = rescale(both, truth, weight)
    return model


def score(seen: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, text_score, meta_score, score and keep (score of at least one half) of every row of features.

    Null texts count as empty; null languages, sources and lengths are values of their own; null ids are scored like
    others and never labelled. Rows are scored one by one, texts of any length as a whole: ties, repeated rows and extra
    columns, whatever their names, make no difference, no rows give none. Without labels of both kinds there is nothing
    to tell apart and all scores are alike.
    """
    shared = seen.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x, y = model.views(*(Rows(batch.column(k)) for k in (1, 2)))
            both = chance(model.mix[0] * (x + y) + model.mix[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in (chance(x), chance(y), both, both >= 0.5))], ["doc_id", "text_score", "meta_score", "score", "keep"])

    return seen.select("doc_id", "t", "m").mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")
