"""Token counts of a document's sections by offset-mapped attribution.

A whole document is encoded once; every token has its character span there. The spans are interval-joined with the
sections: both are sorted and sections tile the text, so a token's first and last section come from binary searches.
A token that crosses a border goes by a rule: to the section of its first character ("start"), of its last ("end"), to
the one with most of its characters, the earlier of equals ("most"), or to each by its share of them ("share").

Sections are what a separator pattern splits, each with the separator behind it; by default lines. The space that is
put before a text counts as part of its first character.

Rows: a null or empty text has one empty section without tokens. Each input row gives its sections, also repeated rows
and rows without an id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trialspark.llm.common import pieces, table
from trialspark.llm.op1_sentencepiece import PieceModel, default_model, piece_model

RULES = ("start", "end", "most", "share")


def borders(text: str, separator: re.Pattern) -> list[int]:
    """Where sections begin, and the end of the text."""
    cuts = [m.end() for m in separator.finditer(text) if m.end() < len(text) and m.end() > m.start()]
    return [0, *cuts, len(text)]


def _shares(begin: int, end: int, edge: np.ndarray, first: int, last: int, rule: str) -> list[tuple[int, float]]:
    if rule == "start" or first == last:
        return [(first, 1.0)]
    if rule == "end":
        return [(last, 1.0)]
    parts = [(k, min(end, int(edge[k + 1])) - max(begin, int(edge[k]))) for k in range(first, last + 1)]
    if rule == "most":
        return [(max(parts, key=lambda p: (p[1], -p[0]))[0], 1.0)]
    return [(k, p / (end - begin)) for k, p in parts]


def section_counts(model: PieceModel, text: str, edge: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of its tokens cross its end."""
    sections = len(edge) - 1
    count, crossing = np.zeros(sections), np.zeros(sections, np.int64)
    words = model.split(text)
    if not words:
        return count, crossing
    number, packed = zip(*map(model.packed.__getitem__, words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    at = np.repeat(np.cumsum(size) - size - 1, number)
    span = np.frombuffer(b"".join(packed), np.int32).reshape(-1, 2)
    begin, end = np.maximum(span[:, 0] + at, 0), np.maximum(span[:, 1] + at, 1)
    # the interval join: both sides are in order, so a token's first and last section come from two searches
    first = np.minimum(np.searchsorted(edge, begin, side="right") - 1, sections - 1)
    last = np.minimum(np.searchsorted(edge, end - 1, side="right") - 1, sections - 1)
    across = first != last
    crossing += np.bincount(first[across], minlength=sections)
    if rule in ("start", "end"):
        return count + np.bincount(first if rule == "start" else last, minlength=sections), crossing
    count += np.bincount(first[~across], minlength=sections)
    for k in np.flatnonzero(across).tolist():
        for s, share in _shares(int(begin[k]), int(end[k]), edge, int(first[k]), int(last[k]), rule):
            count[s] += share
    return count, crossing


def count_sections(docs: DataFrame, rule: str = "start", separator: str = r"\n", model_path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, section, begin, end, n_tokens, n_crossing): sections from 0, characters [begin, end)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    pattern = re.compile(separator)
    kind = docs.schema[doc_id].dataType.simpleString()
    names = [doc_id, "section", "begin", "end", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path or default_model())
        for batch in batches:
            for part in pieces(batch, text):
                edges, counts, crossings = [], [], []
                for t in part.column(text).to_pylist():
                    edges.append(np.array(borders(t or "", pattern)))
                    count, crossing = section_counts(model, t or "", edges[-1], rule)
                    counts.append(count)
                    crossings.append(crossing)
                many = np.array([len(c) for c in counts], np.int64)
                own = pa.array(np.repeat(np.arange(len(many)), many))
                columns = [part.column(doc_id).take(own), pa.array(np.concatenate([np.arange(k) for k in many]), pa.int32())]
                columns += [pa.array(np.concatenate(x), pa.int64()) for x in ([e[:-1] for e in edges], [e[1:] for e in edges])]
                columns += [pa.array(np.concatenate(counts), pa.float64()), pa.array(np.concatenate(crossings), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, section int, begin long, `end` long, n_tokens double, n_crossing long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token on a border counts where it starts."""
    found = count_sections(table(spark, sf_dir, "documents"))
    return found.withColumn("n_tokens", found.n_tokens.cast("long"))
