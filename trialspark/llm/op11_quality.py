"""Quality classifier: naive Bayes support vectors.

Units of a text are indicators of n-grams: words and pairs of words (in lower case), runs of up to three word forms,
and the text's length in powers of two. A form says how a word looks: kind of its first sign, whether it has capitals,
small letters or digits, the signs it ends with, its length and whether it repeats the word before. Units are hashed
into BUCKETS, of which the FEATURES most telling are kept.

Fit, on at most SAMPLE labelled documents (those with the smallest hash of the id, of rows that are not held out): each
unit is scaled by its log-count ratio r = log of (its share among the units of class 1) / (that among those of class 0),
add-one smoothed; texts are brought to length one; on these a linear hinge-loss model with penalty C (weighted so that
both classes count alike) is fitted by dual coordinate descent: one pass sets each document's dual variable to its best
value in [0, C], until none moves by more than ENOUGH or after PASSES. Scores are a logistic curve over margins, fitted
on margins of documents whose fold took no part in their model, so they are shares of class 1 among such documents.

Scores use every word of every text. What the driver holds is bounded by SAMPLE, FEATURES and BUCKETS.

Rows: null and empty texts score as texts without units. Labels without an id or value are ignored; of several for
one id the larger counts, and of several texts of a labelled id the least is fitted. With labels of one kind only all
scores are that kind, without labels 0, and without any frequent unit the share of class 1. Result columns replace input columns of the same name; others are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.llm.common import joined, lower_ascii, mix, pieces, save, small_batches, table, texts, word_names, word_spans
from trialspark.llm.op3_toxicity import _logistic

SAMPLE, FOLDS_OF_FIT = 10_000, 3
BUCKETS, FEATURES = 1 << 20, 20_000
#: Documents a unit must be in to be a feature.
KNOWN_IN = 5
C, PASSES, ENOUGH = 1.0, 30, 0.05
FOLDS, HELD, CUT = 4, 2, 0.7
#: Texts worked on at once.
ROWS = 256

_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_SIGN = ~(_UPPER | _LOWER | _DIGIT)
_SIGN[128:] = False


def held_out(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD


def _forms(data: np.ndarray, start: np.ndarray, end: np.ndarray, name: np.ndarray, head: np.ndarray) -> np.ndarray:
    """A number for how each word looks."""
    form = np.zeros(len(start), np.uint64)
    for kind in (_UPPER, _LOWER, _DIGIT, _SIGN):
        upto = np.r_[0, np.cumsum(kind[data])]
        form = form * np.uint64(4) + kind[data[start]].astype(np.uint64) * np.uint64(2) + (upto[end] > upto[start]).astype(np.uint64)
    for back in (1, 2, 3):  # up to three signs at the end
        at = np.maximum(end - back, start)
        form = form * np.uint64(256) + np.where((end - back >= start) & _SIGN[data[at]], data[at], 0).astype(np.uint64)
    size = np.minimum(np.frexp((end - start).astype(float))[1], 15).astype(np.uint64)
    again = np.r_[False, name[1:] == name[:-1]] & ~head if len(name) else head
    return mix((form * np.uint64(16) + size) * np.uint64(2) + again.astype(np.uint64))


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each unit of the texts of a column, with repetitions."""
    data, at = texts(column)
    start, end, first = word_spans(data, at)
    number = np.diff(first)
    text = np.repeat(np.arange(len(number)), number)
    place = np.arange(len(start)) - first[:-1][text]
    name = word_names(lower_ascii(data), start, end)[:, 0]
    form = _forms(data, start, end, name, place == 0)
    found = [(text, mix(name ^ np.uint64(1)))]
    for base, most in ((name, 2), (form, 3)):
        run = base
        for k in range(1, most + 1):
            if k > 1:
                run = joined(run[:-1], base[k - 1 :])
            inside = place[k - 1 :] >= k - 1
            if base is form or k > 1:
                found.append((text[k - 1 :][inside], mix(run[inside] ^ np.uint64(2 * k + (base is form)))))
    steps = np.frexp(number.astype(float))[1]  # a unit for each power of two that the number of words reaches
    longer = np.repeat(np.arange(len(number)), steps)
    nth = np.arange(len(longer)) - np.repeat(np.cumsum(steps) - steps, steps)
    found.append((longer, mix(nth.astype(np.uint64) + np.uint64(1 << 60))))
    rows, unit = (np.concatenate(x) for x in zip(*found))
    return rows, (unit & np.uint64(BUCKETS - 1)).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, column):
            for k in range(0, len(part), ROWS):
                yield part.slice(k, ROWS)


@dataclass
class Model:
    place: np.ndarray  # of each bucket among the features, -1 if it is none
    ratio: np.ndarray
    weight: np.ndarray
    bias: float = 0.0
    slope: float = 0.0
    shift: float = -50.0

    def features(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Text number and place of the different features of the texts, in rising order."""
        rows, bucket = units(column)
        place = self.place[bucket]
        flags = np.zeros((len(column), len(self.ratio)), bool)
        flags[rows[place >= 0], place[place >= 0]] = True
        return np.nonzero(flags)

    def scores(self, column: pa.Array) -> np.ndarray:
        row, place = self.features(column)
        n = len(column)
        dot, square = (np.bincount(row, v, n) for v in ((self.ratio * self.weight)[place], (self.ratio**2)[place]))
        margin = dot / np.sqrt(np.maximum(square, 1e-12)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, c: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights of the linear hinge-loss model (no bias; give it as a feature) by dual coordinate descent."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    square = np.array([max(float(v @ v), 1e-12) for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            at, x = rows[i], values[i]
            gradient = y[i] * float(w[at] @ x) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), c[i])
            step = new - alpha[i]
            if step:
                w[at] += step * y[i] * x
                alpha[i] = new
                worst = max(worst, abs(step) * square[i])
        if worst < ENOUGH:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id") -> Model:
    """A model from the labelled documents that are not held out."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max(F.col(label) > 0).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = save(rows, "op11-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, "text"):
            y = part.column("y").to_numpy(zero_copy_only=False).astype(bool)
            row, bucket = units(part.column("text"))
            pair = np.unique(row * BUCKETS + bucket)
            unit, at = np.unique(pair % BUCKETS, return_inverse=True)
            good = np.bincount(at, y[pair // BUCKETS], len(unit)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(good), pa.array(np.bincount(at, minlength=len(unit)).astype(np.int64) - good)], ["unit", "good", "bad"])

    counts = save(rows.select("y", "text").mapInArrow(count, "unit long, good long, bad long").groupBy("unit").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "op11-units")
    kinds = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    good, bad = kinds.get(True, 0), kinds.get(False, 0)
    none = Model(np.full(BUCKETS, -1, np.int32), np.zeros(0), np.zeros(0), shift=float(np.log(good / bad)) if good and bad else 50.0 if good else -50.0)
    if not good or not bad:
        return none
    sums = counts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count("*").alias("n")).first()
    odds = F.log((F.col("good") + 1) / (sums["good"] + sums["n"])) - F.log((F.col("bad") + 1) / (sums["bad"] + sums["n"]))
    telling = F.abs(odds) / F.sqrt(1 / (F.col("good") + 1) + 1 / (F.col("bad") + 1))
    kept = counts.where(F.col("good") + F.col("bad") >= KNOWN_IN).select("unit", odds.alias("odds"), telling.alias("telling"))
    kept = kept.orderBy(F.desc("telling"), "unit").limit(FEATURES).select("unit", "odds").toArrow()
    if not kept.num_rows:
        return none
    place = np.full(BUCKETS, -1, np.int32)
    place[kept.column("unit").to_numpy()] = np.arange(kept.num_rows)
    model = Model(place, kept.column("odds").to_numpy(), np.zeros(kept.num_rows))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, "text"):
            row, at = model.features(part.column("text"))
            offsets = np.searchsorted(row, np.arange(len(part) + 1))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at, pa.int32()))], ["doc_id", "y", "places"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    sample = rows.mapInArrow(vectors, f"doc_id {kind}, y boolean, places array<int>").toArrow().sort_by("doc_id")
    y = np.where(sample.column("y").to_numpy().astype(bool), 1.0, -1.0)
    ratio = np.r_[model.ratio, 1.0]
    lists = sample.column("places").combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    rows_, values = [], []
    for a, b in zip(at[:-1], at[1:]):
        x = ratio[flat[a:b]]
        rows_.append(np.r_[flat[a:b], len(model.ratio)])
        values.append(np.r_[x / max(np.sqrt(x @ x), 1e-6), 1.0])
    share = {s: (y == s).mean() for s in (1.0, -1.0)}
    cost = np.array([C * 0.5 / share[s] for s in y.tolist()])
    fold = np.arange(len(y)) % FOLDS_OF_FIT
    margin = np.zeros(len(y))
    for k in range(FOLDS_OF_FIT):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        w = dual_descent([rows_[i] for i in rest], [values[i] for i in rest], y[rest], len(ratio), cost[rest])
        margin[own] = [w[rows_[i]] @ values[i] for i in own]
    w = dual_descent(rows_, values, y, len(ratio), cost)
    model.weight, model.bias = w[:-1], float(w[-1])
    model.slope, model.shift = _logistic(margin, (y > 0).astype(float))
    return model


def judge(docs: DataFrame, model: Model, text: str = "text", cut: float = CUT) -> DataFrame:
    """Input rows with `score` and `predicted`."""
    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    names = [f.name for f in docs.schema.fields if f.name not in added.names]
    out = T.StructType([f for f in docs.schema.fields if f.name in names] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, text):
            score = model.scores(part.column(text))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(score), pa.array((score >= cut).astype(np.int32))], [*names, *added.names])

    return docs.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
