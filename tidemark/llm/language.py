"""Language ID, words first.

A word that training has seen scores by its log frequency in each language. Any other word falls back to its
longest character n-grams that training has seen, then to shorter ones. A document's language is the one with
the highest sum over its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import commonest, drop_saved, sample, saved, slices

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: Documents of each language that a fit reads, about, at most.
SAMPLE_DOCS = 3_000
#: Words and n-grams that a model keeps, the most frequent ones.
MAX_WORDS, MAX_GRAMS = 200_000, 100_000
ORDERS = (5, 4, 3, 2, 1)
#: Unseen words whose scores a worker remembers, their letters at most, words of a text that are summed at once.
REMEMBERED, SHORT, BLOCK = 100_000, 64, 1 << 15


def grams(word: str, order: int) -> Iterator[str]:
    padded = f" {word} "
    return (padded[i : i + order] for i in range(len(padded) - order + 1))


class Rows(dict):
    """A row of the table of scores for each word; unseen words are scored by their n-grams and get one of the last rows."""

    def __init__(self, model: LanguageModel):
        super().__init__(model.words)
        self.model = model
        n = len(model.words)
        self.table = np.zeros((n + REMEMBERED + BLOCK, len(model.languages)), np.float32)
        self.table[:n] = model.word_scores
        self.next = n

    def __missing__(self, word: str) -> int:
        at = self.next
        self.table[at] = self.model.backoff(word)
        self.next += 1
        if len(word) <= SHORT:  # longer ones take a row until the block is summed
            self[word] = at
        return at

    def tidy(self) -> None:
        """Between blocks: forget unseen words before the table is full."""
        if self.next > len(self.model.words) + REMEMBERED:
            self.clear()
            self.update(self.model.words)
            self.next = len(self.model.words)


@dataclass
class LanguageModel:
    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    rows: Rows | None = field(default=None, compare=False, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": None}

    def backoff(self, word: str) -> np.ndarray:
        """Mean score of the word's longest n-grams that are known, over the whole word; zeros if not even a letter is."""
        for order in ORDERS:
            total, n = np.zeros(len(self.languages)), 0
            pieces = grams(word, order)
            while some := list(islice(pieces, BLOCK)):
                known = [i for g in some if (i := self.grams.get(g)) is not None]
                if known:
                    total += self.gram_scores[known].sum(axis=0)
                    n += len(known)
            if n:
                return total / n
        return np.zeros(len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the posterior, tempered by the root of the number of words."""
        words = LETTERS.findall((text or "").lower())
        if not words or not self.languages:
            return UNKNOWN, 0.0
        if self.rows is None:
            self.rows = Rows(self)
        total = np.zeros(len(self.languages))
        for at in range(0, len(words), BLOCK):
            found = list(map(self.rows.__getitem__, words[at : at + BLOCK]))
            total += self.rows.table.take(found, axis=0).sum(axis=0, dtype=np.float64)
            self.rows.tidy()
        best = int(total.argmax())
        spread = np.exp((total - total[best]) / max(1.0, len(words) ** 0.5))
        return self.languages[best], float(spread[best] / spread.sum())


def _entries(found: pa.Table) -> list[pa.Array]:
    """All languages and counts of the lists as two columns: as dicts they take some hundred bytes each, which the driver hasn't."""
    return found["by"].combine_chunks().flatten().flatten()


def _scores(found: pa.Table, key: str, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Log frequencies less their mean over the languages, so that what tells nothing scores 0; ``found`` has a list of (language, count) for each key."""
    names = found[key].to_pylist()
    if not names or not languages:
        return {}, np.zeros((0, len(languages)), np.float32)
    lang, n = _entries(found)
    rows = np.repeat(np.arange(len(names)), pc.list_value_length(found["by"]).to_numpy())
    counts = np.zeros((len(names), len(languages)))
    np.add.at(counts, (rows, pc.index_in(lang, pa.array(languages, lang.type)).to_numpy()), n.to_numpy())
    logs = np.log((counts + 0.2) / (counts.sum(axis=0) + 0.2 * len(names)))
    return {name: i for i, name in enumerate(names)}, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def fit(rows: DataFrame, sample_docs: int = SAMPLE_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> LanguageModel:
    """Learn from the rows' text and lang; rows without a lang are left out, and so are those beyond the sample.

    Counting is distributed; the driver gets the most frequent words and n-grams, as many as the model keeps. Languages
    must be few.
    """
    labelled = rows.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    chosen, share = sample(labelled, "lang", sample_docs)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, Counter] = {}
            for part in slices([batch]):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            flat = [(lang, w, n) for lang, counter in by.items() for w, n in counter.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                times = 1 + int(np.log2(n))  # frequent words must not drown the patterns of the rest
                for order in ORDERS:
                    for g in grams(word, order):
                        found[lang, g] += times
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"]
            )

    def frequent(counts: DataFrame, key: str, most: int) -> pa.Table:
        by = counts.groupBy(key).agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by"))  # a row for each language
        by = saved(by)
        found = commonest(by, "total", most).select(key, "by").toArrow().sort_by(key)
        drop_saved(by)
        return found

    counted = chosen.select("lang", "text").mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = saved(counted)
    words = frequent(counted, "word", max_words)
    pieces = frequent(counted.mapInArrow(count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram", max_grams)
    drop_saved(counted)
    languages = sorted(_entries(words)[0].unique().to_pylist()) if share else []
    return LanguageModel(languages, *_scores(words, "word", languages), *_scores(pieces, "gram", languages))


def identify(docs: DataFrame, model: LanguageModel, *keep: Column) -> DataFrame:
    """doc_id, the kept columns, lang_pred and score for every row.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Of languages with the same
    sum the first by name is taken. Rows are scored one by one, texts and words of any length as a whole: repeated rows
    and ids come back as they are, extra columns are ignored, whatever their names, no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_words and max_grams entries
    rows = docs.select("doc_id", *keep, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for batch in slices(batches):
            found = [predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double")
