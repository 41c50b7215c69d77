"""Suffix-array dedup: a difference-cover suffix sort, and the comparison of neighbouring suffixes.

Texts are UTF-8 bytes, matches never cross documents. A byte goes if a 100-byte string covers it that also starts
earlier (smaller doc_id, or same document and earlier place); strings are judged on the input, not on what is left.

Passages that may repeat come from `repeats`, distributed by the gram they share, so all suffixes that can have 100
bytes in common are in one shard, and a shard is sorted on its own. The sort is the difference-cover one modulo 3:
sort the triples at places 1 and 2 of every three and name them by rank; while names repeat, recurse on the text of
names; sort the remaining suffixes by first byte and the rank behind it; merge both by one or two bytes and a rank.
Neighbours in that order are then compared over 100 bytes, and of strings that are equal only the earliest stays.

Rows: null and empty texts have no bytes. Rows without an id are returned unjudged and are no evidence. Rows that
repeat id and text are one document, each gets its result; where one id has several texts, their places are united.
Result columns replace input columns of the same name, others are passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.llm.common import table
from trialspark.llm.repeats import Unit, remove_repeats

WINDOW_BYTES = 100
GRAM_BYTES = 40

#: Bytes sorted at once in a task (whole groups of passages with one gram; a group has a bounded number of them).
SORT_BYTES = 1 << 19


def _pack(high: np.ndarray, middle: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Three values below 2**21 in one, in the same order."""
    return high << 42 | middle << 21 | low


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of the suffixes of s: values from 1 to 2**21 - 1, fewer than 2**21 of them, no suffix that begins another."""
    n = len(s)
    if n <= 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.r_[s, 0, 0, 0]
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.r_[ones, twos]
    triple = _pack(t[sample], t[sample + 1], t[sample + 2])
    order = np.argsort(triple, kind="stable")
    new = np.r_[True, np.diff(triple[order]) != 0]
    if not new.all():
        name = np.empty(len(sample), np.int64)
        name[order] = np.cumsum(new)
        order = suffix_array(name)
    ranked = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[ranked] = np.arange(1, len(ranked) + 1)
    ranked = ranked[ranked < n]

    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] << 21 | rank[rest + 1], kind="stable")]
    rest_1 = t[rest] << 21 | rank[rest + 1]
    rest_2 = _pack(t[rest], t[rest + 1], rank[rest + 2])
    is_one = ranked % 3 == 1
    one, two = ranked[is_one], ranked[~is_one]
    key_1 = t[one] << 21 | rank[one + 1]
    key_2 = _pack(t[two], t[two + 1], rank[two + 2])
    out = np.empty(n, np.int64)
    out[np.arange(len(rest)) + np.searchsorted(key_1, rest_1) + np.searchsorted(key_2, rest_2)] = rest
    before = np.empty(len(ranked), np.int64)
    before[is_one] = np.searchsorted(rest_1, key_1)
    before[~is_one] = np.searchsorted(rest_2, key_2)
    out[np.arange(len(ranked)) + before] = ranked
    return out


def _repeated(contents: list[bytes], extra: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of these passages that an earlier passage holds: index of the passage, place in it."""
    size = np.array([len(c) for c in contents])
    at = np.r_[0, np.cumsum(size + 1)]
    raw = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    s = raw.astype(np.int64) + 1
    s[at[1:] - 1] = 257 + np.arange(len(contents))  # each passage ends with a sign of its own
    order = suffix_array(s)
    owner = np.repeat(np.arange(len(contents)), size + 1)[order]
    place = order - at[owner]
    begins = place <= extra[owner]
    order, owner, place = order[begins], owner[begins], place[begins]
    padded = np.r_[raw, np.zeros(8, np.uint8)]
    eight = np.zeros(len(raw), np.uint64)
    for k in range(8):
        eight = eight << np.uint64(8) | padded[k : k + len(raw)]
    pair = np.arange(1, len(order))
    for k in sorted({*range(0, window - 7, 8), max(window - 8, 0)}):
        pair = pair[eight[order[pair] + k] == eight[order[pair - 1] + k]]
    if window < 8:
        raise ValueError("windows of 8 bytes or more")
    group = np.ones(len(order), bool)
    group[pair] = False
    group = np.cumsum(group) - 1
    earliest = np.full(group[-1] + 1 if len(group) else 0, len(contents))
    np.minimum.at(earliest, group, owner)
    later = owner > earliest[group]
    return owner[later], place[later]


def judge(window: int):
    def run(contents: list[bytes], key: np.ndarray, doc: np.ndarray, begin: np.ndarray, extra: np.ndarray):
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        filled = np.r_[0, np.cumsum([len(c) + 1 for c in contents])]
        cuts = [0, *heads[1:][np.diff(filled[heads] // SORT_BYTES) > 0].tolist(), len(contents)]
        found = [(w + a, p) for a, b in zip(cuts, cuts[1:]) if b > a for w, p in [_repeated(contents[a:b], extra[a:b], window)]]
        return np.concatenate([w for w, _ in found]), np.concatenate([p for _, p in found])

    return run


def kept_bytes(data: np.ndarray, at: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray, covered: np.ndarray) -> list[pa.Array]:
    """For each text: kept bytes, number of bytes, number removed, number of maximal removed runs."""
    gone = np.r_[0, np.cumsum(covered)]
    head = covered.copy()
    head[1:] &= ~covered[:-1]
    inner = first[:-1][first[:-1] < len(covered)]
    head[inner] = covered[inner]
    runs = np.r_[0, np.cumsum(head)]
    size, removed = np.diff(first), np.diff(gone[first])
    offsets = np.r_[0, np.cumsum(size - removed)].astype(np.int32)
    kept = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[~covered].tobytes())])
    return [kept, pa.array(size), pa.array(removed), pa.array(np.diff(runs[first]))]


def drop_repeats(docs: DataFrame, window: int = WINDOW_BYTES, gram: int = GRAM_BYTES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Input rows with `kept` (remaining bytes), `n_bytes`, `n_removed` and `n_spans`."""
    counts = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    added = T.StructType([T.StructField("kept", T.BinaryType()), *counts])
    return remove_repeats(docs, Unit(False, window, gram), judge(window), kept_bytes, added, text, doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 100-byte strings that also start earlier."""
    done = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
