"""Substring dedup: suffix automata of reference shards, and the documents streamed through them.

A window is 20 consecutive words of one document. A word goes if a window covers it whose words also start earlier
(smaller doc_id, or same document and earlier place); windows are judged on the input, not on what is left.

Passages that may repeat come from `repeats`, in shards by the gram they share. The reference of a shard is what its
earlier documents hold: for each gram a suffix automaton over words grows passage by passage, in the order of
documents. A passage is first streamed through the automaton for its matching statistics (the longest run ending at
each word that an earlier passage holds); where it reaches 20 words, the window ending there is a repeat. Then it is
added. So the automaton answers "also starts earlier" without any positions in it.

The reference grows with the corpus, so it is not broadcast: shards travel to the passages that share their grams, and
one automaton holds CROWD passages at most (see `repeats` for grams with more).

Rows: null and empty texts have no words and keep none. Rows without an id are returned unjudged and are no evidence.
Rows that repeat id and text are one document, each gets its result; where one id has several texts, their places are
united. Result columns replace input columns of the same name, others are passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.llm.common import table
from trialspark.llm.repeats import Unit, remove_repeats

WINDOW_WORDS = 20
GRAM_WORDS = 8


class SuffixAutomaton:
    """All runs of words of the passages added so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _end(self, p: int, word) -> int:
        """The state of the run that ends with `word` behind state p's longest run, all its suffixes included."""
        nxt, link, length = self.next, self.link, self.length
        q = nxt[p].get(word)
        if q is None:
            new = self._state(length[p] + 1, {}, 0)
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = new
                p = link[p]
            if p >= 0:
                link[new] = self._own(p, word)
            return new
        return self._own(p, word)

    def _own(self, p: int, word) -> int:
        """The state whose longest run is p's longest run and `word`, split off if it is not one yet."""
        nxt, link, length = self.next, self.link, self.length
        q = nxt[p][word]
        if length[q] == length[p] + 1:
            return q
        part = self._state(length[p] + 1, dict(nxt[q]), link[q])
        link[q] = part
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = part
            p = link[p]
        return part

    def add(self, words: list) -> None:
        state = 0
        for w in words:
            state = self._end(state, w)

    def matches(self, words: list) -> list[int]:
        """Matching statistics: for each word the length of the longest known run that ends with it."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(w)
            if to is None:
                matched = 0
            else:
                state = to
                matched += 1
            out.append(matched)
        return out


def judge(window: int):
    def run(contents: list[bytes], key: np.ndarray, doc: np.ndarray, begin: np.ndarray, extra: np.ndarray):
        which, place, automaton, last = [], [], None, None
        ends = np.r_[key[1:] != key[:-1], True]
        for k, (content, own, ending) in enumerate(zip(contents, key.tolist(), ends.tolist())):
            words = content.split()
            if own != last:
                automaton, last = SuffixAutomaton(), own
            else:
                for at, matched in enumerate(automaton.matches(words), 1 - window):
                    if matched >= window:
                        which.append(k)
                        place.append(at)
            if not ending:
                automaton.add(words)
        return np.array(which, np.int64), np.array(place, np.int64)

    return run


def kept_words(data: np.ndarray, at: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray, covered: np.ndarray) -> list[pa.Array]:
    """For each text: kept words joined by one space, number of words, number removed."""
    stay = np.flatnonzero(~covered)
    begin, stop = start[stay], end[stay]
    number = np.searchsorted(stay, first)
    kept = np.diff(number)
    ending = np.zeros(len(stay), bool)
    ending[number[1:][kept > 0] - 1] = True
    edge = np.zeros(len(data) + 2, np.int64)
    edge[begin] += 1
    np.add.at(edge, stop + ~ending, -1)  # with the white byte behind it, but for a text's last
    mask = np.cumsum(edge)[: len(data)] > 0
    out = data.copy()
    out[stop[~ending]] = 32
    size = np.add.reduceat(np.r_[stop - begin + ~ending, 0], np.minimum(number[:-1], len(stay))) if len(stay) else np.zeros(len(kept), np.int64)
    size = np.where(kept > 0, size, 0)
    offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
    text = pa.StringArray.from_buffers(len(kept), pa.py_buffer(offsets), pa.py_buffer(out[mask].tobytes()))
    words = np.diff(first)
    return [text, pa.array(words), pa.array(words - kept)]


def drop_repeats(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Input rows with `kept_text` (kept words joined by one space), `n_words` and `n_removed`."""
    added = T.StructType([T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return remove_repeats(docs, Unit(True, window, gram), judge(window), kept_words, added, text, doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 20-word passages that also start earlier."""
    done = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
