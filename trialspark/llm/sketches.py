"""Word shingles of texts and their one-permutation sketches."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa

from trialspark.llm.common import Runs, coded_words, lower_ascii, mix, ragged, texts, word_names, word_spans

#: Bands and rows of a band. A pair of similarity 0.8 shares no bucket with probability (1 - 0.8^6)^48 = 5e-7,
#: one of similarity 0.2 shares one with 0.003.
BANDS, BAND_ROWS = 48, 6
SLOTS = BANDS * BAND_ROWS
_TRIES = 40


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each text in rising order, and where each text's begin.

    Words are runs of other than ASCII white space, A-Z in lower case. A text of fewer words than a shingle has is one
    shingle; one without words has none.
    """
    data, at = texts(column)
    data = lower_ascii(data)
    start, end, first = word_spans(data, at)
    runs = Runs(word_names(data, start, end)[:, 0])
    count = np.diff(first)
    number = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    begin = ragged(first[:-1], number)
    text = np.repeat(np.arange(len(number)), number)
    value = runs.hash(begin, np.minimum(begin + words, first[1:][text]))
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])] if len(value) else np.zeros(0, bool)
    return value[new], np.searchsorted(text[new], np.arange(len(number) + 1))


def exact_sets(column: pa.Array | pa.ChunkedArray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """As `shingle_sets`, but shingles are numbered by their words themselves: numbers agree if and only if the words do.
    The numbers hold for this column alone."""
    data, at = texts(column)
    data = lower_ascii(data)
    start, end, first = word_spans(data, at)
    word = coded_words(data, start, end).indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    count = np.diff(first)
    number = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    begin = ragged(first[:-1], number)
    text = np.repeat(np.arange(len(number)), number)
    stop = first[1:][text]
    shingle = word[begin]
    wide = np.int64(word.max(initial=0) + 1)
    for k in range(1, words):  # 0 stands for no further word
        more = np.where(begin + k < stop, word[np.minimum(begin + k, max(len(word) - 1, 0))], 0)
        shingle = pd.factorize(shingle * wide + more)[0]
    value = np.unique(text << 40 | shingle)
    return value & ((1 << 40) - 1), np.searchsorted(value >> 40, np.arange(len(number) + 1))


def set_names(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of a cryptographic hash of each set's sorted values."""
    raw = np.ascontiguousarray(value).view(np.uint8).data
    names = b"".join(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist()))
    pair = np.frombuffer(names, np.int64).reshape(-1, 2)
    return pair[:, 0].copy(), pair[:, 1].copy()


def sketch(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of SLOTS values for each set with any.

    One permutation, its range cut into slots: a slot holds the least value that falls in it. An empty slot takes the
    value of a full one, found by its own fixed random sequence of slots (optimal densification), so that slots of
    two sets agree with the probability of their similarity however few values the sets have.
    """
    number = np.diff(at)
    text = np.repeat(np.arange(len(number)), number)
    slot = ((value >> np.uint64(32)) * np.uint64(SLOTS) >> np.uint64(32)).astype(np.int64)
    place = text * SLOTS + slot
    head = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    full = np.zeros(len(number) * SLOTS, bool)
    out = np.zeros(len(number) * SLOTS, np.uint64)
    full[place[head]] = True
    out[place[head]] = value[head]
    source = np.arange(len(out))
    empty = np.flatnonzero(~full & np.repeat(number > 0, SLOTS))
    own = empty % SLOTS
    base = empty - own
    for k in range(_TRIES):
        to = base + (mix(own.astype(np.uint64) * np.uint64(1009) + np.uint64(k * 1_000_003 + 7)) % np.uint64(SLOTS)).astype(np.int64)
        hit = full[to]
        source[empty[hit]] = to[hit]
        empty, own, base = empty[~hit], own[~hit], base[~hit]
        if not len(empty):
            break
    if len(empty):  # sets of few values: the full slot that the empty one ranks first
        places = np.flatnonzero(full)
        owner = places // SLOTS
        left, right = np.searchsorted(owner, empty // SLOTS), np.searchsorted(owner, empty // SLOTS, side="right")
        choice = ragged(left, right - left)
        rank = mix(np.repeat(own, right - left).astype(np.uint64) * np.uint64(SLOTS) + (places[choice] % SLOTS).astype(np.uint64) + np.uint64(1 << 40))
        starts = np.cumsum(right - left) - (right - left)
        least = np.minimum.reduceat(rank, starts)
        pick = np.flatnonzero(rank == np.repeat(least, right - left))
        which = np.searchsorted(starts, pick, side="right") - 1
        source[empty[which]] = places[choice[pick]]
    return out[source].reshape(-1, SLOTS)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """BANDS bucket keys for each sketch."""
    parts = rows.reshape(len(rows), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(11), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(BAND_ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key
