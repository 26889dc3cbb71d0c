"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Text is folded first: lower case, compatibility forms, look-alike letters of other
scripts, invisible characters, and digits or signs that stand for letters inside a word;
everything but letters becomes one space. Entries are beginnings of words (" foo") or
whole words (" foo "). Exception phrases are matched by the same automaton and cancel
the entries inside them. An entry's hits count relative to the root of the number of
words, on a log scale, times its weight; the sum goes through the logistic function.

The lexicon and its weights are learned from labelled documents: beginnings of words
that are far more frequent in toxic ones (document counts), then a regularised logistic
regression. The model is fitted on at most ``FIT_ROWS`` labelled rows, those with the
smallest hashes of doc_id; everything else covers all rows.

Defined results: null is the empty text, which gets the score of a text without hits;
a null doc_id is not held out and never learned from, nor are null labels; of several
labels of one document the largest counts; without toxic or without clean examples there
is no lexicon and every score is the share of toxic examples (0 without examples); an
empty table gives an empty table; a column with the name of the score is replaced.
"""

from __future__ import annotations

import dataclasses
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trafficlens.llm.kept import release
from trafficlens.session import written

#: The most labelled rows that the model is fitted on.
FIT_ROWS = 8000
#: The most entries, the letters of a word's beginning, and the toxic documents and the
#: log ratio of document shares that an entry needs.
ENTRIES, SHORTEST, LONGEST, LEAST_DOCS, LEAST_RATIO = 800, 3, 8, 5, 1.0
#: The most exception phrases, and the clean documents that one needs.
EXCEPTIONS, EXCEPTION_DOCS = 200, 8
#: A document at or above this score is toxic.
TOXIC = 0.3
#: Strength of the regularisation.
RIDGE = 1.0

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = str.maketrans(
    "абвгеёзіјкмнорсԁѕтухһԛԝүαβγεηικνορτυχω",
    "abbreezijkmhopcdstyxhqwyabyenikvoptuxw",
)
#: Digits and signs that stand for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_foreign = re.compile("[Ͱ-ӿԀ-ԯ]")
_hidden = re.compile("[­​-‏⁠﻿]")
_stand_in = re.compile(r"[013457@$!8](?=[013457@$!8]{0,3}[^\W\d_])")
_apart = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower()
        if _hidden.search(text):
            text = _hidden.sub("", text)
        if _foreign.search(text):
            text = text.translate(LOOK_ALIKES)
    text = _stand_in.sub(lambda m: STAND_INS[m[0]], text)
    return f" {_apart.sub(' ', text).strip()} "


def beginnings(folded: str) -> set[str]:
    """What of a text may become an entry: beginnings of its words and whole words."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in range(SHORTEST, min(LONGEST, len(word)) + 1))
    return out


@dataclasses.dataclass(frozen=True)
class Model:
    """entries and their weights; exceptions cancel the entries that they hold."""

    entries: tuple[str, ...] = ()
    weights: tuple[float, ...] = ()
    bias: float = 0.0
    exceptions: tuple[str, ...] = ()

    def automaton(self):
        out = ahocorasick.Automaton()
        for i, entry in enumerate(self.entries):
            out.add_word(entry, (i, len(entry)))
        for phrase in self.exceptions:
            out.add_word(phrase, (-1, len(phrase)))
        if len(out):
            out.make_automaton()
        return out


def hits(automaton, folded: str) -> Counter:
    """Entries by number, and how often each is found outside exceptions."""
    if not len(automaton):
        return Counter()
    spared: list[tuple[int, int]] = []
    found = []
    for end, (entry, length) in automaton.iter(folded):
        if entry < 0:
            spared.append((end - length, end))
        else:
            found.append((end - length, end, entry))
    if spared:
        # An entry's closing space may lie outside the phrase.
        found = [x for x in found if not any(a <= x[0] and x[1] <= b + 1 for a, b in spared)]
    return Counter(entry for _, _, entry in found)


def strength(count, words: int):
    """Hits relative to the length of the text, on a log scale."""
    return np.log1p(100.0 * count / np.sqrt(max(words, 1)))


def score_text(model: Model, automaton, text: str | None) -> float:
    folded = fold(text)
    words = folded.count(" ") - 1
    total = model.bias
    for entry, count in hits(automaton, folded).items():
        total += model.weights[entry] * strength(count, words)
    return float(1.0 / (1.0 + np.exp(-np.clip(total, -500, 500))))


# --- learning -----------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic): labelled documents that are not held out, at most ``rows``."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    # Bounded by its limit: two numbers a row.
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, toxic documents, clean documents) of each batch."""
    release()
    for batch in batches:
        for first in range(0, batch.num_rows, 1000):
            piece = batch.slice(first, 1000)
            by = (Counter(), Counter())
            for text, toxic in zip(piece.column("text").to_pylist(), piece.column("toxic").to_pylist()):
                by[toxic > 0].update(beginnings(fold(text)))
            grams = list(by[0] | by[1])
            yield pa.RecordBatch.from_pydict({
                "gram": grams, "toxic": pa.array([by[1][g] for g in grams], pa.int64()),
                "clean": pa.array([by[0][g] for g in grams], pa.int64())})


def choose(counts: Iterable[tuple[str, int, int]], limit: int = ENTRIES) -> list[str]:
    """Of entries in the order of their merit, those that say something of their own.

    An entry goes if one letter more finds the same documents: the longer one is more
    special. A whole word goes if its beginning finds the same.
    """
    counts = list(counts)
    by = {gram: (toxic, clean) for gram, toxic, clean in counts}
    longer = {(gram[:-1], by[gram]) for gram in by if not gram.endswith(" ")}
    out = []
    for gram, *found in counts:
        whole = gram.endswith(" ")
        if whole and by.get(gram[:-1]) == tuple(found) or not whole and (gram, tuple(found)) in longer:
            continue
        out.append(gram)
    return out[:limit]


def _features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            out: dict[str, list] = {"toxic": [], "entries": [], "strengths": []}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                folded = fold(text)
                found = hits(automaton, folded)
                out["toxic"].append(int(toxic > 0))
                out["entries"].append(list(found))
                out["strengths"].append([float(strength(n, folded.count(" ") - 1)) for n in found.values()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["toxic"], pa.int32()), pa.array(out["entries"], pa.list_(pa.int32())),
                 pa.array(out["strengths"], pa.list_(pa.float64()))], ["toxic", "entries", "strengths"])

    return run


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 30) -> np.ndarray:
    """Weights and, last, the bias: Newton's method with a ridge on the weights."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -500, 500)))
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x
        curve[np.diag_indices_from(curve)] += penalty
        step = np.linalg.solve(curve, x.T @ (p - y) + penalty * b)
        b -= step
        if np.abs(step).max() < 1e-6:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    known = written(examples(docs, labels, rows), "toxicity-examples")
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.expr("int(toxic > 0)")), F.lit(0))).first()
    if not toxic or toxic == n:
        share = min(max(toxic / n if n else 0.0, 0.0), 1.0)
        return Model(bias=500.0 if share == 1.0 else -500.0)
    spread = known.repartition(16)
    counts = spread.mapInArrow(_counts, "gram string, toxic long, clean long")
    counts = counts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = (F.log((F.col("toxic") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n - toxic + 1.0)))
    counts = written(counts.withColumn("ratio", ratio), "toxicity-counts")
    merit = F.col("ratio") * F.sqrt("toxic")
    best = counts.where((F.col("toxic") >= LEAST_DOCS) & (F.col("ratio") > LEAST_RATIO)).orderBy(
        merit.desc(), "gram").limit(ENTRIES * 12)
    entries = choose([tuple(r) for r in best.select("gram", "toxic", "clean").collect()])
    # Whole words of clean documents that begin like an entry.
    calm = counts.where((F.col("clean") >= EXCEPTION_DOCS) & (F.col("toxic") == 0) & F.col("gram").endswith(" ")).orderBy(
        F.desc("clean"), "gram").limit(ENTRIES * 12)
    heads = tuple(e for e in entries if not e.endswith(" "))
    exceptions = [r["gram"] for r in calm.select("gram").collect() if heads and r["gram"].startswith(heads)]
    model = Model(tuple(entries), (0.0,) * len(entries), 0.0, tuple(exceptions[:EXCEPTIONS]))
    # As many rows as the examples have.
    found = spread.mapInArrow(_features(model), "toxic int, entries array<int>, strengths array<double>").collect()
    x, y = np.zeros((len(found), len(entries))), np.zeros(len(found))
    for i, row in enumerate(found):
        y[i] = row["toxic"]
        x[i, row["entries"]] = row["strengths"]
    fitted = _regression(x, y)
    return dataclasses.replace(model, weights=tuple(map(float, fitted[:-1])), bias=float(fitted[-1]))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The documents with their score from 0 to 1."""
    kept = [c for c in docs.columns if c != name]
    schema = docs.select(*kept).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        automaton = model.automaton()
        for batch in batches:
            scores = [score_text(model, automaton, t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, name])

    return docs.select(*kept).mapInArrow(run, schema)
