"""Toxic passages as maximal scoring segments.

A token's weight is its log-odds between toxic and clean documents under a Dirichlet prior that follows the
background frequencies, moved towards 0 by its own error, less a constant drift. Beginnings of words are counted
like words, so that unseen forms of a toxic stem weigh what the stem does; documents are counted, not occurrences,
so that a text that repeats itself counts once. All maximal scoring segments of a text come out of one linear scan. A segment's score is calibrated against what clean text of that length
reaches by chance: its expectation is K n exp(-lambda S), with lambda from the background and K from clean
documents. A document's score is a logistic curve through the strongest segment's -log expectation.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import commonest, drop_saved, rescale, sample, saved, slices

TOKENS = re.compile(r"\w+")
#: Documents of each label that a fit reads, about, at most.
SAMPLE_DOCS = 12_000
#: Tokens that a model keeps, those with the largest weights, and tokens that are weighed, the most frequent ones.
MAX_TOKENS, WEIGHED = 100_000, 400_000
DRIFT = 0.6
#: Lengths of the beginnings of words that stand in for a word.
STEMS = (4, 5, 6)
#: Tokens whose weights a worker remembers.
REMEMBERED = 400_000
#: Weight of the prior as a share of all counts.
PRIOR = 0.06
#: Errors by which a log-odds is moved towards 0.
CAUTION = 1.0
#: A segment is significant if chance is expected to bring fewer than this.
EXPECTED = 0.05


def segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order; linear in the number of weights.

    Only runs of positive weights are visited. ``link`` leads to the nearest earlier candidate that starts
    lower, so each candidate is passed over once.
    """
    up = weights > 0
    if not up.any():
        return []
    total = np.r_[0.0, np.cumsum(weights)]
    edge = np.flatnonzero(np.diff(np.r_[False, up, False].astype(np.int8)))
    starts, ends, lows, highs, link = [], [], [], [], []
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        low, high = float(total[s]), float(total[e])
        while True:
            j = len(lows) - 1
            while j >= 0 and lows[j] >= low:
                j = link[j]
            if j < 0 or highs[j] >= high:
                break
            s, low = starts[j], lows[j]
            del starts[j:], ends[j:], lows[j:], highs[j:], link[j:]
        starts.append(s)
        ends.append(e)
        lows.append(low)
        highs.append(high)
        link.append(j)
    return [(s, e, h - lo) for s, e, lo, h in zip(starts, ends, lows, highs, strict=True)]


class Weights(dict):
    """Weights by token; that of an unknown token is its strongest stem's, and it is remembered."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems = words, stems

    def __missing__(self, token: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        seen = (self.words.get(token, 0.0), *(self.stems.get(token[:n], 0.0) for n in STEMS if len(token) >= n))
        self[token] = value = max(seen, key=abs) - DRIFT
        return value

    def __reduce__(self):
        return Weights, (self.words, self.stems)


@dataclass
class ToxicityModel:
    weights: Weights
    rate: float  # lambda
    log_k: float
    slope: float
    intercept: float

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Number of tokens; (first token, end, score, expected by chance) of each maximal segment."""
        tokens = TOKENS.findall((text or "").lower())
        values = np.fromiter(map(self.weights.__getitem__, tokens), np.float64, len(tokens))
        return len(tokens), [(s, e, v, float(np.exp(min(50.0, self.log_k + np.log(len(tokens)) - self.rate * v)))) for s, e, v in segments(values)]

    def evidence(self, tokens: int, found: list[tuple[int, int, float, float]]) -> float:
        """-log of the least expectation, with that of a score of 0 at least."""
        best = max((v for _, _, v, _ in found), default=0.0)
        return self.rate * best - self.log_k - float(np.log(max(1, tokens)))

    def score(self, tokens: int, found: list[tuple[int, int, float, float]]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.evidence(tokens, found) + self.intercept, -30, 30))))


def token_weights(toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds moved towards 0 by their error, and the tokens' smoothed shares of clean text."""
    prior = PRIOR * (toxic + clean)
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (a.sum() - a + 1)) - np.log(b / (b.sum() - b + 1))
    error = np.sqrt(1 / a + 1 / b)
    return np.sign(odds) * np.maximum(0, np.abs(odds) - CAUTION * error), b / b.sum()


def chance_rate(weights: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share exp(lambda weight)) = 1 for weights less the drift."""
    gap = lambda x: float((shares * np.exp(np.clip(x * (weights - DRIFT), -700, 700))).sum()) - 1
    if not (weights > DRIFT).any():
        return 1.0
    low, high = 1e-6, 1.0
    while gap(high) < 0 and high < 64:
        high *= 2
    if gap(low) > 0:
        return 1.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if gap(middle) < 0 else (low, middle)
    return low


def weigh(found: pa.Table, toxic: str, clean: str, max_tokens: int) -> tuple[Weights, float]:
    """Weights of words and stems by their counts in the named columns, and lambda."""
    names, stem = np.array(found["token"].to_pylist(), dtype=object), found["stem"].to_numpy(zero_copy_only=False).astype(bool)
    t, c = found[toxic].to_numpy().astype(float), found[clean].to_numpy().astype(float)
    kept: tuple[dict[str, float], ...] = ({}, {})
    rate = 1.0
    for level in (True, False):
        at = np.flatnonzero((stem == level) & (t + c > 0))
        weights, shares = token_weights(t[at], c[at])
        best = np.argsort(-np.abs(weights), kind="stable")[:max_tokens]
        kept[level].update((names[at[i]], float(weights[i])) for i in best if weights[i] != 0)
        if len(at) and not level:
            rate = chance_rate(weights, shares)
    return Weights(*kept), rate


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, max_tokens: int = MAX_TOKENS) -> ToxicityModel:
    """Learn from the text of documents and their labels' toxic (1 or 0; others are left out), a bounded sample of each.

    The calibration holds each half of the sample against weights of the other half. Labels are sampled before
    their documents are looked up, so at most the sample is broadcast and no text is shuffled. The calibration weighs
    each label by the inverse of its sampled share, so that its threshold is that of all labelled documents.
    """
    labelled = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    few, share = sample(labelled, "toxic", sample_docs)  # about sample_docs rows of either label
    chosen = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("toxic", half, "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = [Counter() for _ in range(4)]
            for label, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = set(TOKENS.findall((text or "").lower()))
                by[2 * part + label].update((t, False) for t in tokens)
                by[2 * part + label].update({(t[:n], True) for t in tokens for n in STEMS if len(t) >= n})
            names = list(set().union(*by))
            columns = [pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([c[x] for x in names], pa.int64()) for c in by)], ["token", "stem", "c0", "t0", "c1", "t1"])

    counted = chosen.mapInArrow(count, "token string, stem boolean, c0 long, t0 long, c1 long, t1 long")
    counted = counted.groupBy("token", "stem").agg(*(F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")))
    every = saved(counted.select("*", F.expr("t0 + t1 AS t"), F.expr("c0 + c1 AS c"), F.expr("t0 + t1 + c0 + c1 AS n")))
    found = commonest(every, "n", WEIGHED).drop("n").toArrow().sort_by([("token", "ascending"), ("stem", "ascending")])
    drop_saved(every)
    halves = [ToxicityModel(*weigh(found, f"t{i}", f"c{i}", max_tokens), 0.0, 1.0, 0.0) for i in (1, 0)]

    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(1).to_pylist()
            seen = [halves[i].passages(t) for i, t in zip(parts, batch.column(2).to_pylist(), strict=True)]
            x = [halves[i].evidence(*s) for i, s in zip(parts, seen, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64()), pa.array([bool(s[1]) for s in seen])], ["toxic", "x", "any"])

    seen = chosen.mapInArrow(examine, "toxic int, x double, any boolean").toArrow()
    label, x = seen["toxic"].to_numpy().astype(float), seen["x"].to_numpy()
    clean = x[(label == 0) & seen["any"].to_numpy(zero_copy_only=False).astype(bool)]
    log_k = float(clean.mean() - np.euler_gamma) if len(clean) > 20 else 0.0  # a Gumbel's mean is its place plus Euler's constant
    slope, intercept = rescale(x - log_k, label, np.where(label > 0, 1 / share.get(1, 1.0), 1 / share.get(0, 1.0)))
    return ToxicityModel(*weigh(found, "t", "c", max_tokens), log_k, max(0.0, slope), intercept)


def score(docs: DataFrame, model: ToxicityModel, *keep: Column) -> DataFrame:
    """doc_id, the kept columns, score, passages for every row; ``passages`` holds the significant segments.

    Null and empty texts have no passages and the score of a text without any toxic token. Rows are scored one
    by one, texts of any length as a whole: null ids, ties, repeated rows and extra columns, whatever their names, make
    no difference, no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", *keep, F.col("text").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            seen = [model.passages(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            kept = [[{"start": s, "end": e, "score": v, "expected": x} for s, e, v, x in found if x <= EXPECTED] for _, found in seen]
            columns = [*batch.columns[:-1], pa.array([model.score(*x) for x in seen], pa.float64()), pa.array(kept, kind)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "score", "passages"])

    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{named}, score double, passages array<struct<start: long, end: long, score: double, expected: double>>")
