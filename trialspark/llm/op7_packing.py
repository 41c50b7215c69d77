"""Packing: length buckets that are optimal for the corpus, and batches of a token budget inside each.

Lengths in tokens are counted once and stored. Dynamic programming over their whole histogram, each length with its
count, chooses the bucket lengths with the least padding of all choices: the best k buckets over the first j lengths
extend the best k - 1 over some i, found for all j in one pass over a convex hull of lines. The histogram is what the
driver holds: different lengths add up to no more than all tokens T, so there are at most sqrt(2 T) of them (a few
million for any corpus there is).

A batch of a bucket holds budget // length documents (one, if a document is longer than the budget). Documents are
numbered inside their bucket by id, over many tasks (`ranks`), so a bucket, and rows that share an id or have none, may
be any share of the rows.

Rows: every input row gets one output row. A null or empty text has no tokens: bucket length 0, no batch. Rows without
an id are placed like others. Rows that repeat an id are placed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import pieces, save, table
from trialspark.llm.op1_sentencepiece import default_model, piece_model
from trialspark.llm.ranks import numbered

BUCKETS, BUDGET = 16, 16_384


def token_lengths(docs: DataFrame, model_path: str | None = None, text: str = "text", doc_id: str = "doc_id", keep_words: bool = True) -> DataFrame:
    """(doc_id, n_tokens) of every row. A worker keeps the words it knows for its next task, or frees them for jobs of other kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path or default_model())
        for batch in batches:
            for part in pieces(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(doc_id), pa.array([model.count(t or "") for t in part.column(text).to_pylist()], pa.int64())], [doc_id, "n_tokens"])
        if not keep_words:
            model.forget()

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens long")


def best_lengths(top: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Bucket lengths with the least padding for these different lengths (rising) and their counts.

    cost[j], the least padded size of the first j lengths, is the least over i of cost'[i] + (before[j] - before[i]) *
    top[j - 1]: the lowest of lines with slopes -before[i] at a place that only rises.
    """
    tops, n = [int(t) for t in top], len(top)
    before = [0]
    for c in count:
        before.append(before[-1] + int(c))
    cost: list[int | None] = [0] + [None] * n
    cuts = []
    for _ in range(min(buckets, n)):
        new: list[int | None] = [None] * (n + 1)
        came = np.zeros(n + 1, np.int64)
        hull: list[int] = []
        low = 0
        for j in range(1, n + 1):
            i = j - 1
            if cost[i] is not None:
                while len(hull) - low >= 2:
                    a, b = hull[-2], hull[-1]  # b is nowhere lowest if the new line passes a before b does
                    if (cost[i] - cost[a]) * (before[b] - before[a]) <= (cost[b] - cost[a]) * (before[i] - before[a]):
                        hull.pop()
                    else:
                        break
                hull.append(i)
            x = tops[i]
            while len(hull) - low >= 2 and cost[hull[low + 1]] - before[hull[low + 1]] * x <= cost[hull[low]] - before[hull[low]] * x:
                low += 1
            if len(hull) > low:
                k = hull[low]
                new[j], came[j] = cost[k] + (before[j] - before[k]) * x, k
        cost = new
        cuts.append(came)
    lengths, j = [], n
    for came in reversed(cuts):
        lengths.append(tops[j - 1])
        j = int(came[j])
        if not j:
            break
    return lengths[::-1]


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, bucket_length, batch, place): rows of one bucket_length and batch form a batch, ordered by place."""
    n = F.col("n_tokens")
    none = lengths.where("n_tokens = 0").select(doc_id, "n_tokens", F.lit(0).cast("long").alias("bucket_length"), F.lit(None).cast("long").alias("batch"), F.lit(None).cast("int").alias("place"))
    counts = lengths.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("count")).toArrow().sort_by("n_tokens")
    if not counts.num_rows:
        return none
    chosen = best_lengths(counts.column("n_tokens").to_numpy(), counts.column("count").to_numpy(), buckets)
    length = F.lit(chosen)[F.size(F.filter(F.lit(chosen), lambda b: b < n))].cast("long")
    rows = numbered(lengths.where("n_tokens > 0").select(doc_id, "n_tokens", length.alias("bucket_length")), ["bucket_length"], [doc_id, "n_tokens"], "number", "held", "op7-numbered")
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket_length")).cast("long"))
    placed = rows.select(doc_id, "n_tokens", "bucket_length", F.floor(F.col("number") / room).cast("long").alias("batch"), (F.col("number") % room).cast("int").alias("place"))
    return placed.unionByName(none)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a batch."""
    return pack(save(token_lengths(table(spark, sf_dir, "documents")), "op7-lengths"))
