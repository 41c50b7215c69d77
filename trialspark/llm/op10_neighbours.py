"""Approximate nearest neighbours: adaptive dimension scan within the probed lists of an inverted file.

Vectors are assigned to lists by their nearest centroid; a query is compared with the vectors of the lists whose
centroids are nearest to it. Inside a list all vectors are seen in the same randomly rotated axes, so the first t of d
axes estimate the whole distance. The scan goes through the axes in blocks of columns and after each block tests the
hypothesis that a candidate is no farther than the query's k-th best so far; where partial distance * d / t exceeds
that by more than the estimate's spread allows, (1 + SPREAD / sqrt(t))^2 times, the candidate is abandoned. Survivors
are measured on the original vectors in double precision, ties go to the smaller id.

Centroids are fitted on at most SAMPLE vectors (chosen by hash of the id) and number at most MOST_LISTS, so what is
broadcast is bounded; every vector is indexed. Equal vectors are one candidate with its k + 1 smallest ids, found
before any shuffle as far as a task sees them: more can be in no answer. A list is cut into blocks of about BLOCK
vectors, its queries into blocks of about ASKED, and each pair of blocks is scanned in a task of its own, so a list may
have any number of both. Each scan returns at most k rows a query. What is shuffled grows with the table as queries *
probed lists (a share of sqrt(rows)), and with queries / ASKED copies of a list's vectors.

With probed = 1 every list is probed: exact but for what the axes' test abandons, and exact altogether with `spread`
infinite. Vectors keep the precision they are given in (float or double); all measuring is done in doubles.

Rows: vectors that are null, zero, hold null or non-finite components, have no id, or have another length than most
vectors take no part, as query or candidate. Rows that repeat an id are the same vector's copies and never answer to
their own id. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.llm.common import save, table

SAMPLE = 20_000
MOST_LISTS = 4096
#: Share of the lists that a query probes, and their least number. High, as embeddings may have hardly any clusters: on
#: random directions in 64 dimensions a tenth finds six in ten neighbours, half finds over nine in ten.
PROBED, LEAST_PROBED = 0.5, 32
BLOCK, ASKED = 4096, 1024
#: Columns of a block, and the spread of a partial distance that the test allows.
COLUMNS, SPREAD = 16, 2.1
_ROUNDS, _SEED = 12, 20


def _rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, always the same for a dimension."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    score = (centroids**2).sum(1) - 2 * (x @ centroids.T)
    if n == 1:
        return score.argmin(1)[:, None]
    near = np.argpartition(score, n - 1, axis=1)[:, :n] if n < score.shape[1] else np.tile(np.arange(n), (len(x), 1))
    return np.take_along_axis(near, np.argsort(np.take_along_axis(score, near, 1), axis=1, kind="stable"), 1)


def fit_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """k-means on a sample; a list that runs empty takes a random row."""
    rng = np.random.default_rng(_SEED)
    centroids = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(_ROUNDS):
        own = np.concatenate([_nearest(x[a : a + 4096], centroids, 1)[:, 0] for a in range(0, len(x), 4096)])
        count = np.bincount(own, minlength=lists)
        order = np.argsort(own, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.r_[0, np.cumsum(count)[:-1]], len(x) - 1), axis=0)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(len(x), size=lists)])
    return centroids


def scan(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, spread: float = SPREAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k nearest of x: query id, id, distance."""
    d = x.shape[1]
    turn = _rotation(d)
    rx, rq = x @ turn, queries @ turn
    columns = [np.ascontiguousarray(rx[:, a : a + COLUMNS]) for a in range(0, d, COLUMNS)]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lead = min(len(x), max(4 * k, 64))
    largest = float((rx**2).sum(1).max(initial=0.0))
    for q, turned, own in zip(queries, rq, query_ids):
        first = ((rx[:lead] - turned) ** 2).sum(1)
        first[ids[:lead] == own] = np.inf
        worst = np.partition(first, k - 1)[k - 1] if lead >= k else np.inf
        slack = 1e-14 * math.sqrt(largest + turned @ turned)  # rounding of the rotation
        alive, part, seen = np.arange(len(x)), np.zeros(len(x)), 0
        for c in columns:
            part = part + ((c[alive] - turned[seen : seen + c.shape[1]]) ** 2).sum(1)
            seen += c.shape[1]
            if np.isfinite(worst):
                bound = (math.sqrt(worst) * (1 + 1e-9) + slack) ** 2 * ((1 + spread / math.sqrt(seen)) ** 2 * seen / d if seen < d else 1)
                stay = part <= bound
                alive, part = alive[stay], part[stay]
        alive = alive[ids[alive] != own]
        if len(alive) > k:  # of what is left, those that can be among the k after exact measuring
            part = ((rx[alive] - turned) ** 2).sum(1)
            alive = alive[part <= (math.sqrt(np.partition(part, k - 1)[k - 1]) * (1 + 1e-9) + slack) ** 2]
        exact = np.sqrt(((x[alive] - q) ** 2).sum(1))
        best = np.lexsort((ids[alive], exact))[:k]
        out.append((np.full(len(best), own), ids[alive][best], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Vectors that take part, whatever their length."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(embedding, lambda x: x != 0)
    kind = "float" if isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType) else "double"
    return vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("embedding")).where(~bad & some)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding", probed: float = PROBED, spread: float = SPREAD) -> DataFrame:
    """Of each vector whose id is divisible by `every` the k nearest others: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    good = usable(vectors, vec_id, embedding)
    most = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = most["d"]
    good = good.where(F.size("embedding") == d)
    drawn = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    lists = max(1, min(MOST_LISTS, round(2 * math.sqrt(most["count"])), drawn.num_rows // 8))
    probes = min(lists, max(LEAST_PROBED, math.ceil(probed * lists)))
    centroids = fit_centroids(_matrix(drawn.column("embedding"), d), lists)

    copies = Window.partitionBy("embedding").orderBy("vec_id")
    candidates = good.distinct().withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).select("vec_id", "embedding", F.lit(False).alias("wanted"))
    queries = good.where(F.col("vec_id") % every == 0).select("vec_id", "embedding", F.lit(True).alias("wanted"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted").to_numpy(zero_copy_only=False).astype(bool)
            x = _matrix(pa.chunked_array([batch.column("embedding")]), d)
            rows, near = [np.flatnonzero(~wanted), np.repeat(np.flatnonzero(wanted), probes)], []
            for which, n in ((~wanted, 1), (wanted, probes)):
                near.append(_nearest(x[which], centroids, n).ravel() if which.any() else np.zeros(0, np.int64))
            index = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(near), pa.int32()), *(batch.column(c).take(index) for c in ("vec_id", "embedding", "wanted"))], ["list", "vec_id", "embedding", "wanted"])

    placed = save(candidates.union(queries).mapInArrow(assign, f"list int, vec_id long, embedding {good.schema['embedding'].dataType.simpleString()}, wanted boolean"), "op10-lists")
    sizes = placed.groupBy("list", "wanted").count().collect()  # two rows a list, MOST_LISTS at most
    blocks, parts = np.ones(lists, np.int64), np.ones(lists, np.int64)
    for r in sizes:
        (parts if r["wanted"] else blocks)[r["list"]] = -(-r["count"] // (ASKED if r["wanted"] else BLOCK))
    blocks_, parts_ = (F.lit(n.tolist())[F.col("list")] for n in (blocks, parts))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    mine = placed.where(~F.col("wanted")).withColumn("block", dealt(blocks_)).withColumn("part", to_all(parts_))
    asked = placed.where("wanted").withColumn("part", dealt(parts_)).withColumn("block", to_all(blocks_))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = not left.num_rows or not right.num_rows
        parts = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)] if empty else scan(_matrix(right.column("embedding"), d), right.column("vec_id").to_numpy(), _matrix(left.column("embedding"), d), left.column("vec_id").to_numpy(), k, spread)
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    found = mine.groupBy("list", "block", "part").cogroup(asked.groupBy("list", "block", "part")).applyInArrow(compare, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector."""
    return nearest(table(spark, sf_dir, "embeddings"))
