"""Toxicity: every significant toxic passage by maximum-scoring segments of token log-odds.

Fit, on at most SAMPLE labelled documents (those with the smallest hash of the id, of rows that are not held out):
units are words and runs of GRAM bytes at word edges or inside words. A unit's weight is the log-odds ratio of its
share in toxic and clean documents under a Dirichlet prior of the common shares; weights count if they exceed their
standard error Z times. A word known from several documents has its own weight, a rarer one the largest weight of its
grams; all others have one small negative score, the log-ratio of having no weight in toxic and clean documents.

Score, every whole text in one pass: the maximal scoring segments of its words (linear time). A segment's score is put
in units of chance: among clean words the best segment of n words exceeds x with probability 1 - exp(-K n exp(-rate x)),
with rate the root of E exp(rate * score) = 1 over clean words and K from the clean documents of the fit. Passages with
fewer than MOST_BY_CHANCE such segments by chance are reported; the best one's log of expected number gives, by a
logistic curve fitted on the same documents, the document's score.

The model is a few hundred kilobytes at most (KNOWN_WORDS, MOST_UNITS); nothing that grows with the corpus is
collected. Rows: null and empty texts score as texts without any toxic word. Labels without an id or value are
ignored; of several for one id the larger counts, and of several texts of a labelled id the least is fitted. Without labelled rows of both kinds all scores are 0. Result columns
replace input columns of the same name; others are passed through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.llm.common import lower_ascii, mix, pieces, table, texts, word_names
from trialspark.llm.sketches import shingle_sets

SAMPLE = 20_000
KNOWN_WORDS, MOST_UNITS = 50_000, 5_000
#: Documents a word must be in to be known; standard errors and log-odds that a weight must reach.
KNOWN_IN, Z, LEAST = 5, 4.0, 1.0
GRAM = 5
MOST_BY_CHANCE = 0.01
CERTAIN = 20.0
FOLDS, HELD = 5, 0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD


def _units(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Of the texts of a column: where each one's words begin, words' hashes, and grams' hashes and words."""
    data, at = texts(column)
    data = lower_ascii(data)
    letter = _LETTER[data]
    plain = np.where(letter, data, 32).astype(np.uint8)
    # a border between texts, so that no word or gram reaches across
    number = len(at) - 1
    spread = np.full(len(data) + number + 1, 32, np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(number), np.diff(at)) + 1
    spread[place] = plain
    at = at + np.arange(number + 1)
    inside = spread != 32
    start = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    end = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    first = np.searchsorted(start, at)
    words = word_names(spread, start, end, inside)[:, 0]
    n = max(len(spread) - GRAM + 1, 0)
    grams = np.zeros(n, np.uint64)  # the bytes themselves
    for k in range(GRAM):
        grams = grams << np.uint64(8) | spread[k : k + n]
    grams = mix(grams)
    borders = np.r_[0, np.cumsum(~inside)]
    inner = (borders[GRAM - 1 : GRAM - 1 + n] - borders[1 : 1 + n]) == 0 if n else np.zeros(0, bool)  # no border but at the ends
    return first, words, grams, inner, start


def _gram_words(start: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.searchsorted(start, place + 1, side="right") - 1


@dataclass
class Model:
    words: np.ndarray
    word_weights: np.ndarray
    grams: np.ndarray
    gram_weights: np.ndarray
    other: float = -0.01
    rate: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    shift: float = -50.0

    def scored(self, column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Of each text: number of words, and place and weight of the words that have one."""
        first, words, grams, inner, start = _units(column)
        value = np.zeros(len(words))
        known = _found(self.words, words)
        if len(self.grams):
            hit = np.flatnonzero(_maybe(self.grams, grams) & inner)
            which = _found(self.grams, grams[hit])
            hit, which = hit[which >= 0], which[which >= 0]
            if len(hit):
                np.maximum.at(value, _gram_words(start, hit), self.gram_weights[which])
        if len(self.words):
            value[known >= 0] = self.word_weights[known[known >= 0]]
        spots = np.flatnonzero(value > 0)
        left, right = np.searchsorted(spots, first[:-1]), np.searchsorted(spots, first[1:])
        return [(int(b - a), spots[i:j] - a, value[spots[i:j]]) for a, b, i, j in zip(first[:-1], first[1:], left, right)]

    def log_expected(self, best: float, words: int) -> float:
        """Minus the log of the number of such segments expected in a clean text."""
        return self.rate * best - math.log(self.k * max(words, 1))

    def curve_place(self, surprise: np.ndarray) -> np.ndarray:
        """Beyond CERTAIN more evidence tells no more."""
        return np.clip(surprise, -CERTAIN, CERTAIN)

    def score(self, surprise: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.curve_place(surprise) + self.shift, -50, 50)))


def _maybe(table_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """False for most values that are not in a small table."""
    seen = np.zeros(1 << 16, bool)
    seen[(table_ >> np.uint64(48)).astype(np.int64)] = True
    return seen[(values >> np.uint64(48)).astype(np.int64)]


def _found(table_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place in a sorted table, -1 if absent."""
    if not len(table_):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table_, values), len(table_) - 1)
    return np.where(table_[at] == values, at, -1)


def segments(places: np.ndarray, weights: np.ndarray, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) of a sequence that scores `other` (negative) but at `places`.

    Each place opens a segment, remembered with the running sum before and behind it and with the nearest earlier one
    that begins lower. A new one is joined with the nearest that begins lower than itself, as long as that one's end is
    no higher than its own. The search follows those pointers, past all that begin no lower: linear time.
    """
    held: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, 0
    for at, weight in zip(places.tolist(), weights.tolist()):
        low = total + (at - last) * other
        total = high = low + weight
        begin, last = at, at + 1
        k = len(held) - 1
        while True:
            while k >= 0 and held[k][2] >= low:
                k = held[k][4]
            if k < 0 or held[k][3] >= high:
                held.append((begin, last, low, high, k))
                break
            begin, low, before = held[k][0], held[k][2], held[k][4]
            del held[k:]
            k = before
    return [(a, b, high - low) for a, b, low, high, _ in held]


def _log_odds(toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratio and its standard error, with a Dirichlet prior of the common shares as large as the toxic class."""
    n1, n0 = max(toxic.sum(), 1), max(clean.sum(), 1)
    prior = n1 * (toxic + clean) / (n1 + n0) + 1e-9
    a, b = toxic + prior, clean + prior
    return np.log(a / (2 * n1 - a + 1)) - np.log(b / (n0 + n1 - b + 1)), np.sqrt(1 / a + 1 / b)


def _unlike(rows: DataFrame) -> DataFrame:
    """Ids of sampled documents (SAMPLE at most) without most copies: words of a text that is there many times would
    look telling. Near copies mostly share the least hash of their word triples, or the least of a second hash."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                value, at = shingle_sets(part.column("text"), 3)
                some = np.diff(at) > 0
                out = np.zeros((2, len(at) - 1), np.uint64)
                for k, v in enumerate((value, mix(value))):
                    if some.any():
                        out[k, some] = np.minimum.reduceat(v, at[:-1][some])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(o.view(np.int64)) for o in out)], ["doc_id", "one", "two"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    marks = rows.select("doc_id", "text").mapInArrow(least, f"doc_id {kind}, one long, two long").toPandas().sort_values("doc_id")
    kept = marks.drop_duplicates("one").drop_duplicates("two")
    return rows.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(kept["doc_id"])})).select(F.col("doc_id").cast(kind).alias("doc_id"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Model:
    """A model from the labelled documents that are not held out."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    rows = rows.join(F.broadcast(_unlike(rows)), "doc_id").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                toxic = part.column("toxic").to_numpy(zero_copy_only=False) > 0
                first, words, grams, inner, start = _units(part.column("text"))
                spots = np.flatnonzero(inner)
                owner = np.searchsorted(first, np.arange(len(words)), side="right") - 1
                for kind, value, of in ((0, words, owner), (1, grams[spots], owner[np.clip(_gram_words(start, spots), 0, None)] if len(words) else spots[:0])):
                    if len(value) != len(of) or not len(value):
                        continue
                    pair = np.unique(np.stack([value, of.astype(np.uint64)], 1), axis=0)
                    unit, at = np.unique(pair[:, 0], return_inverse=True)
                    hot = np.bincount(at, toxic[pair[:, 1].astype(np.int64)], len(unit)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), kind), pa.int32()), pa.array(unit.view(np.int64)), pa.array(hot), pa.array(np.bincount(at, minlength=len(unit)).astype(np.int64) - hot)], ["kind", "unit", "hot", "cool"])

    counts = rows.mapInArrow(count, "kind int, unit long, hot long, cool long").groupBy("kind", "unit").agg(F.sum("hot").alias("hot"), F.sum("cool").alias("cool"))
    counts = counts.where(F.col("hot") + F.col("cool") >= KNOWN_IN).cache()
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("hot").alias("hot"), F.sum("cool").alias("cool")).collect()}
    if 0 not in sums or not sums[0]["hot"] or not sums[0]["cool"]:
        counts.unpersist()
        none = np.zeros(0, np.uint64)
        return Model(none, np.zeros(0), none, np.zeros(0))
    # which units carry weight is settled by share, most telling first; then at most so many are taken
    telling = F.col("hot") / (F.col("hot") + F.col("cool")) * F.sqrt("hot")
    words = counts.where("kind = 0").orderBy(F.desc(telling + F.log1p(F.col("hot") + F.col("cool"))), "unit").limit(KNOWN_WORDS).toArrow()
    grams = counts.where("kind = 1").orderBy(F.desc(telling), "unit").limit(MOST_UNITS).toArrow()
    counts.unpersist()
    tables = []
    for t, total in ((words, sums[0]), (grams, sums.get(1, sums[0]))):
        unit = t.column("unit").to_numpy().view(np.uint64)
        hot, cool = (np.r_[t.column(c).to_numpy().astype(float), 0.0] for c in ("hot", "cool"))
        hot[-1], cool[-1] = max(total["hot"] - hot.sum(), 0), max(total["cool"] - cool.sum(), 0)
        odds, error = _log_odds(hot, cool)
        weight = np.where((odds >= LEAST) & (odds >= Z * error), odds, 0.0)[:-1]
        order = np.argsort(unit)
        tables.append((unit[order], weight[order]))
    (word_units, word_weights), (gram_units, gram_weights) = tables
    strong = gram_weights > 0
    model = Model(word_units, word_weights, gram_units[strong], gram_weights[strong])
    return _calibrated(model, rows)


def _calibrated(model: Model, rows: DataFrame) -> Model:
    """`other`, `rate`, K and the logistic curve, from the documents of the fit (SAMPLE rows of numbers at most)."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = model.scored(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("toxic"), pa.array([n for n, _, _ in found], pa.int64()), pa.array([p.astype(np.int64) for _, p, _ in found], pa.list_(pa.int64())), pa.array([w for _, _, w in found], pa.list_(pa.float64()))],
                    ["toxic", "n", "places", "weights"],
                )

    # texts are unbounded but their weighted words are few: per document the sums, and the best segment once `other` is known
    scored = rows.mapInArrow(hits, "toxic int, n long, places array<long>, weights array<double>").cache()
    by = {r["toxic"] > 0: r for r in scored.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.sum("n").alias("n"), F.sum(F.size("weights")).alias("hits")).collect()}
    hot, cool = by[True], by[False]
    share = [(r["hits"] + 0.5) / (r["n"] + 1) for r in (hot, cool)]
    model.other = min(math.log((1 - min(share[0], 0.9)) / (1 - min(share[1], 0.9))), -1e-3)
    # log-odds ratios in steps of a hundredth: some thousand different ones at most
    clean = scored.where("toxic = 0").select(F.explode("weights").alias("w")).groupBy(F.round("w", 2).alias("w")).count().collect()
    weight, number = np.array([r["w"] for r in clean] or [1.0]), np.array([r["count"] for r in clean] or [0.5], float)
    p, rest = number / (cool["n"] + 1), 1 - number.sum() / (cool["n"] + 1)
    low, high = 1e-6, 50.0
    for _ in range(80):
        middle = (low + high) / 2
        total = (p * np.exp(np.minimum(middle * weight, 500))).sum() + rest * math.exp(middle * model.other)
        low, high = (middle, high) if total < 1 else (low, middle)
    model.rate = (low + high) / 2
    other = model.other

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = [max([s for _, _, s in segments(np.array(p, np.int64), np.array(w), other)], default=0.0) for p, w in zip(batch.column("places").to_pylist(), batch.column("weights").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("n"), pa.array(top, pa.float64())], ["toxic", "n", "best"])

    points = scored.mapInArrow(best, "toxic int, n long, best double").toArrow()
    scored.unpersist()
    y, n, top = (points.column(c).to_numpy().astype(float) for c in ("toxic", "n", "best"))
    y = (y > 0).astype(float)
    some = top[(y == 0) & (top > 0)]
    cut = float(np.median(some)) if len(some) else LEAST
    model.k = max((np.sum((y == 0) & (top >= cut)) + 0.5) / max(np.sum(n[y == 0]) * math.exp(-model.rate * cut), 1e-300), 1e-12)
    x = model.curve_place(np.array([model.log_expected(a, b) for a, b in zip(top, n)]))
    model.slope, model.shift = _logistic(x, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a one-variable logistic curve with a little ridge (Newton steps, halved if they overshoot)."""
    centre, scale = x.mean(), x.std() + 1e-9
    z = np.stack([(x - centre) / scale, np.ones(len(x))], 1)
    beta, ridge = np.zeros(2), np.diag([1e-2, 1e-6])

    def loss(b):
        t = z @ b
        return np.logaddexp(0, t).sum() - (y * t).sum() + 0.5 * b @ ridge @ b

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -50, 50)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge, z.T @ (p - y) + ridge @ beta)
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-4:
            size /= 2
        beta = beta - size * step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * centre / scale)


def judge(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Input rows with `score`, `predicted` and `passages` (begin and end word, score, log10 of the number expected by chance)."""
    passage = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("log10_expected", T.DoubleType())]))
    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", passage)])
    names = [f.name for f in docs.schema.fields if f.name not in added.names]
    out = T.StructType([f for f in docs.schema.fields if f.name in names] + added.fields)
    arrow = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("log10_expected", pa.float64())]))
    most = -math.log(MOST_BY_CHANCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                surprise, passages = [], []
                for n, places, weights in model.scored(part.column(text)):
                    found = segments(places, weights, model.other) if len(places) else []
                    logs = [model.log_expected(s, n) for _, _, s in found]
                    surprise.append(max(logs, default=model.log_expected(0.0, n)))
                    passages.append([(a, b, s, -e / math.log(10)) for (a, b, s), e in zip(found, logs) if e >= most])
                score = model.score(np.array(surprise))
                columns = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(passages, arrow)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], [*names, *added.names])

    return docs.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
