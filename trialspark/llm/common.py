"""Small helpers of the corpus operators: tables, the shared folder, Arrow columns, hashes of symbol runs."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

#: Text bytes worked on at once inside a task; a longer document is a piece of its own.
PIECE_BYTES = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C13)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`, or where it is unset one in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    return path or f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Texts cross to Python in batches of bounded bytes, so that a task's memory does not follow the length of texts.
    A bound that the session's owner has set is left as it is."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and where each text begins (one more entry than texts). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `most` bytes of text each. Behind the last, Arrow's pool gives back what it holds free:
    workers live on between stages, and several share an executor's memory."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(size):
        return
    group = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = np.asarray(x).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    #: Two independent symbols for each byte.
    BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    OTHER_BYTE_SYMBOLS = mix(BYTE_SYMBOLS ^ np.uint64(0xA0761D6478BD642F))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two halves from theirs, neither linear in the first nor the same for both orders."""
    with np.errstate(over="ignore"):
        return mix((a ^ (a >> np.uint64(32))) * _ODD + b)


class Runs:
    """64-bit hashes of any runs [i, j) of one symbol sequence.

    The hash of 2w symbols is mixed from those of both halves; a run of another length from those of its first and last
    w symbols, w the largest power of two within it, and its length. Nothing is summed up, so no content cancels out.
    """

    def __init__(self, symbols: np.ndarray):
        self.levels = [mix(symbols)]

    def _level(self, k: int) -> np.ndarray:
        """Hashes of all runs of 2**k symbols. Levels of long sequences are not kept, but made again."""
        keep = len(self.levels[0]) <= 4 * PIECE_BYTES
        at, width = (self.levels[min(k, len(self.levels) - 1)], 1 << min(k, len(self.levels) - 1))
        while width < 1 << k:
            at = joined(at[: max(len(at) - width, 0)], at[width:])
            width *= 2
            if keep:
                self.levels.append(at)
        return at

    def _covered(self, first: np.ndarray, last: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return joined(joined(first, last), np.asarray(size).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = np.asarray(end - begin)
        out = np.zeros(len(size), np.uint64)
        which = np.frexp(np.maximum(size, 1).astype(float))[1] - 1
        for k in np.unique(which[size > 0]).tolist():
            some = np.flatnonzero((which == k) & (size > 0))
            level = self._level(k)
            out[some] = self._covered(level[begin[some]], level[end[some] - (1 << k)], size[some])
        return out

    def grams(self, k: int) -> np.ndarray:
        """The hash of every run of k symbols."""
        n = max(len(self.levels[0]) - k + 1, 0)
        power = k.bit_length() - 1
        level = self._level(power)
        off = k - (1 << power)
        return self._covered(level[:n], level[off : off + n], np.uint64(k))


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def rolling(symbols: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k symbols by a rolling sum: cheap, to deal out rows by. Runs that share one need not be equal."""
    n = len(symbols)
    if len(_powers[0]) < n + 1:
        with np.errstate(over="ignore"):
            for j, base in enumerate((_ODD, _INVERSE)):
                steps = np.full(max(n + 1, 2 * PIECE_BYTES), base, np.uint64)
                steps[0] = 1
                _powers[j] = np.cumprod(steps, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(symbols * _powers[0][:n], dtype=np.uint64, out=sums[1:])
        m = max(n - k + 1, 0)
        return mix((sums[k:] - sums[:m]) * _powers[1][:m])


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """Two 64-bit halves of a cryptographic hash of each word (`word_spans`), taken once for each different word."""
    coded = coded_words(data, start, end, inside)
    names = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in coded.dictionary.to_pylist())
    return np.frombuffer(names, np.uint64).reshape(-1, 2)[coded.indices.to_numpy(zero_copy_only=False)]


def coded_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, inside: np.ndarray | None = None) -> pa.DictionaryArray:
    """The words of some texts as a dictionary and places in it; `inside` marks their bytes, if not all but white ones."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    letters = data[~WHITE[data] if inside is None else inside]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()


def content_names(content: memoryview, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a cryptographic hash of each slice of some bytes."""
    names = b"".join([hashlib.blake2b(content[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist())])
    pair = np.frombuffer(names, np.uint64).reshape(-1, 2)
    return pair[:, 0].copy(), pair[:, 1].copy()


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in the bytes, and where each text's words begin in that list."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    white = WHITE[data]
    begins, ends = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    begins[0], ends[-1] = True, True
    begins[1:-1] = white[:-1]
    ends[1:-1] = white[1:]
    begins[at] = True
    ends[at] = True
    word = ~white
    start = np.flatnonzero(word & begins[:-1])
    end = np.flatnonzero(word & ends[1:]) + 1
    return start, end, np.searchsorted(start, at)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    total = int(count.sum())
    skip = np.cumsum(count) - count
    return np.arange(total) - np.repeat(skip - begin, count)
