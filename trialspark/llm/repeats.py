"""Runs of symbols that also start earlier in the corpus: the frame that substring and suffix-array dedup share.

A window is `window` consecutive symbols (words or bytes) of one document; it is a repeat if the same symbols also
start earlier (smaller doc_id, or same document and earlier place). All symbols that repeats cover are to go.

1. Each window is represented by its smallest gram (hash order, leftmost of equals): equal windows have the same
   gram at the same place. Neighbouring windows with one gram form a context, the symbols those windows span; about
   2 in (window - gram + 2) places begin one. This thins the work, no window is left out.
2. Contexts meet by gram. Of equal contexts the first stays and the others are repeats throughout; equal means equal in
   128 bits of a cryptographic hash of the bytes (of words: of 128-bit cryptographic hashes of the words). A gram with one
   context is settled; one with several is contested: its contexts share some windows, and which ones is decided on
   their real symbols by the operator's own method (`judge`). So passages that are copied with what surrounds them
   are settled by hash, and `judge` finds the edges, where copies end.
3. Spans found in 2 go back to their documents and are united there.

A place is a document and a symbol number: the same symbols at one place, given by repeated rows or by several texts of
one id, are one occurrence and no repeat of each other.

Load: equal contexts are reduced before each shuffle to one row a batch or group, so a passage with any number of
copies stays small. A gram with more than CROWD contexts is not judged in one place: its contexts are cut into single
windows, each keyed by its own content (by 128 bits again, then `judge`). Rows travel as columns of lists, one row a
batch and shard. There is a shard for each SHARD_BYTES of text, so what a task holds at once does not grow with the
table, whatever the number of partitions. Nothing is collected, broadcast or sampled; a lost executor costs what it held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.llm.common import BYTE_SYMBOLS, OTHER_BYTE_SYMBOLS, Runs, content_names, mix, pieces, ragged, rolling, texts, word_names, word_spans

#: Contexts of one gram that are judged together.
CROWD = 256
#: Text bytes of a shard of documents, gram shards for one of them, and the least number. A group writes at most one row
#: for each shard it meets, and never more than it has contexts.
SHARD_BYTES, GRAM_SHARDS, LEAST_SHARDS = 8 << 20, 2, 8


class Symbols:
    """A sequence of bytes, or of words by their 128-bit names."""

    def __init__(self, data: np.ndarray | None, names: np.ndarray | None):
        self.data, self.names = data, names
        self.width = 1 if names is None else 16
        self.raw = np.ascontiguousarray(data if names is None else names).reshape(-1).view(np.uint8).data
        self._runs: tuple[Runs, Runs] | None = None

    def grams(self, k: int) -> np.ndarray:
        """What contexts are dealt out by: those that share one are compared themselves."""
        return rolling(BYTE_SYMBOLS[self.data] if self.names is None else self.names[:, 0], k)

    def named(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for the content of each run."""
        return content_names(self.raw, begin * self.width, end * self.width)

    def windows(self, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each of many overlapping runs of one width."""
        if self._runs is None:
            lanes = (BYTE_SYMBOLS[self.data], OTHER_BYTE_SYMBOLS[self.data]) if self.names is None else (self.names[:, 0], self.names[:, 1])
            self._runs = tuple(Runs(s) for s in lanes)
        return tuple(runs.hash(at, at + width) for runs in self._runs)


@dataclass(frozen=True)
class Unit:
    """What a symbol is, how long a window is, and how long the grams that represent it are."""

    words: bool
    window: int
    gram: int

    def symbols(self, data: np.ndarray, at: np.ndarray) -> tuple[Symbols, np.ndarray, np.ndarray, np.ndarray]:
        """The symbols, where each text's begin, and begin and end byte of each symbol."""
        if not self.words:
            place = np.arange(len(data) + 1)
            return Symbols(data, None), at, place[:-1], place[1:]
        start, end, first = word_spans(data, at)
        return Symbols(None, word_names(data, start, end)), first, start, end

    def places(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`symbols` without values."""
        if not self.words:
            place = np.arange(len(data) + 1)
            return at, place[:-1], place[1:]
        start, end, first = word_spans(data, at)
        return first, start, end


@dataclass
class Contexts:
    key: np.ndarray
    ctx: np.ndarray
    ctx2: np.ndarray  # the other half of the content's hash
    doc: np.ndarray
    begin: np.ndarray  # first symbol
    extra: np.ndarray  # windows less one

    def take(self, index: np.ndarray) -> Contexts:
        return Contexts(*(v[index] for v in vars(self).values()))

    @staticmethod
    def none() -> Contexts:
        return Contexts(*(np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64)))

    @staticmethod
    def join(parts: list[Contexts]) -> Contexts:
        return Contexts(*(np.concatenate(v) for v in zip(*(vars(p).values() for p in parts))))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[: len(values) - step], values[step:])
        done += step
    return values


def contexts(unit: Unit, symbols: Symbols, first: np.ndarray, ids: np.ndarray) -> Contexts:
    """The contexts of some texts (numbered `ids`; text k has symbols first[k] to first[k + 1])."""
    count = np.maximum(np.diff(first) - unit.window + 1, 0)
    if not count.sum():
        return Contexts.none()
    windows = ragged(first[:-1], count)
    grams = symbols.grams(unit.gram)
    low = np.uint64(0xFFFFFFFF)
    order = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    chosen = (_least(order, unit.window - unit.gram + 1)[windows] & low).astype(np.int64)
    change = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    begin, last = windows[change], windows[np.r_[change[1:] - 1, len(windows) - 1]]
    gram = chosen[change]
    text = np.searchsorted(first, begin, side="right") - 1
    stop = last + unit.window
    return Contexts(grams[gram], *symbols.named(begin, stop), ids[text], begin - first[text], last - begin)


def windows_of(unit: Unit, symbols: Symbols, at: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> Contexts:
    """Single windows, each under a key of its own content."""
    none = np.zeros(len(at), np.int64)
    return Contexts(*symbols.windows(at, unit.window), none.view(np.uint64), doc, begin, none)


def settle(c: Contexts) -> tuple[Contexts, np.ndarray, np.ndarray]:
    """First occurrences sorted by gram and content, how many contents their gram has, and the other occurrences
    (indexes of the input). One occurrence given twice counts once."""
    order = np.lexsort((c.begin, c.doc, c.ctx2, c.ctx, c.key))
    s = c.take(order)
    if not len(order):
        return s, np.zeros(0, np.int64), order
    same_key = np.r_[False, s.key[1:] == s.key[:-1]]
    same_ctx = same_key & np.r_[False, (s.ctx[1:] == s.ctx[:-1]) & (s.ctx2[1:] == s.ctx2[:-1])]
    head = np.flatnonzero(~same_ctx)
    own = np.cumsum(~same_ctx) - 1
    again = same_ctx & (s.doc == s.doc[head][own]) & (s.begin == s.begin[head][own])
    number = np.cumsum(~same_key)[head]
    return s.take(head), np.bincount(number)[number], order[same_ctx & ~again]


def _once(c: Contexts) -> np.ndarray:
    """Indexes of one of each gram, content and place."""
    order = np.lexsort((c.begin, c.doc, c.ctx2, c.ctx, c.key))
    s = c.take(order)
    new = (s.key[1:] != s.key[:-1]) | (s.ctx[1:] != s.ctx[:-1]) | (s.ctx2[1:] != s.ctx2[:-1]) | (s.doc[1:] != s.doc[:-1]) | (s.begin[1:] != s.begin[:-1])
    return np.sort(order[np.r_[True, new][: len(order)]])


def _later_windows(unit: Unit, contents: list[bytes], c: Contexts) -> Contexts:
    """The windows of these contexts that also start at an earlier place of one of them."""
    symbols, first, _, _ = unit.symbols(np.frombuffer(b"".join(contents), np.uint8), np.r_[0, np.cumsum([len(x) for x in contents])])
    number = c.extra + 1
    w = ragged(first[:-1], number)
    windows = windows_of(unit, symbols, w, np.repeat(c.doc, number), w - np.repeat(first[:-1] - c.begin, number))
    return windows.take(settle(windows)[2])


_LONGS, _INTS = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
#: kind 0: contexts by shard of their gram; kind 1: spans [begin, begin + extra) by shard of their document;
#: kind 2: contested contexts, and kind 3: those of a crowded gram, by shard of their document.
_ROWS = T.StructType(
    [T.StructField("kind", T.IntegerType()), T.StructField("shard", T.IntegerType())]
    + [T.StructField(n, _LONGS) for n in ("key", "ctx", "ctx2", "doc")]
    + [T.StructField(n, _INTS) for n in ("begin", "extra")]
    + [T.StructField("content", T.ArrayType(T.BinaryType()))]
)
_ARROW = pa.schema(
    [("kind", pa.int32()), ("shard", pa.int32()), *((n, pa.list_(pa.int64())) for n in ("key", "ctx", "ctx2", "doc")), ("begin", pa.list_(pa.int32())), ("extra", pa.list_(pa.int32())), ("content", pa.list_(pa.binary()))]
)


def _pack(kind: int, shard: np.ndarray, c: Contexts, content: list[bytes] | None = None) -> pa.RecordBatch:
    """One row for each shard."""
    order = np.argsort(shard, kind="stable")
    own, start = np.unique(shard[order], return_index=True)
    at = pa.array(np.r_[start, len(order)], pa.int32())
    c = c.take(order)
    lists = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(v).view(np.int64))) for v in (c.key, c.ctx, c.ctx2, c.doc)]
    lists += [pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))) for v in (c.begin, c.extra)]
    if content is None:
        lists.append(pa.nulls(len(own), _ARROW.field("content").type))
    else:
        lists.append(pa.ListArray.from_arrays(at, pa.array([content[k] for k in order], pa.binary())))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind), pa.int32()), pa.array(own, pa.int32()), *lists], schema=_ARROW)


def _unpack(t: pa.Table) -> Contexts:
    def flat(name, kind):
        return t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)

    key, ctx, ctx2, doc = (flat(n, np.int64) for n in ("key", "ctx", "ctx2", "doc"))
    return Contexts(key.view(np.uint64), ctx.view(np.uint64), ctx2.view(np.uint64), doc, flat("begin", np.int64), flat("extra", np.int64))


def _united(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Contexts:
    """Spans with overlapping and touching ones of a document made one; `extra` is the length."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    if len(doc):
        number = np.cumsum(np.r_[True, doc[1:] != doc[:-1]])
        wide = np.int64(max(int(end.max()), 1) + 1)
        reach = np.maximum.accumulate(end + number * wide) - number * wide
        head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (begin[1:] > reach[:-1])])
        doc, begin, end = doc[head], begin[head], reach[np.r_[head[1:] - 1, len(reach) - 1]]
    none = np.zeros(len(doc), np.uint64)
    return Contexts(none, none, none, doc, begin, end - begin)


def _of_doc(doc: np.ndarray, shards: int) -> np.ndarray:
    return (mix(doc.view(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _of_key(key: np.ndarray, shards: int) -> np.ndarray:
    return (mix(key) % np.uint64(shards)).astype(np.int64)


def _empty() -> pa.Table:
    return _ARROW.empty_table()


Judge = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def remove_repeats(docs: DataFrame, unit: Unit, judge: Judge, finish: Callable, added: T.StructType, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Input rows with what `finish` makes of each text and its repeated symbols.

    judge(contents, key, doc, begin, extra) gets contested contexts sorted by (key, doc, begin), and says which of
    their windows start earlier within their group: indexes of contexts, and of windows in them.
    finish(unit, batch, covered) gets rows, and for each symbol of their texts whether a repeat covers it; it returns
    arrays for the columns `added`, which replace input columns of the same name.
    """
    held = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-held // SHARD_BYTES))
    gram_shards = GRAM_SHARDS * shards
    names = [f.name for f in docs.schema.fields if f.name not in added.names]
    out = T.StructType([f for f in docs.schema.fields if f.name in names] + added.fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in pieces(batch, text):
                symbols, first, _, _ = unit.symbols(*texts(part.column(text)))
                found.append(contexts(unit, symbols, first, part.column(doc_id).to_numpy(zero_copy_only=False).astype(np.int64)))
            if found:
                c = Contexts.join(found)
                heads, _, rest = settle(c)
                yield _pack(0, _of_key(heads.key, gram_shards), heads)
                r = c.take(rest)
                spans = _united(r.doc, r.begin, r.begin + r.extra + unit.window)
                yield _pack(1, _of_doc(spans.doc, shards), spans)

    def meet(t: pa.Table) -> pa.Table:
        c = _unpack(t)
        if t.column("kind")[0].as_py() == 1:
            spans = _united(c.doc, c.begin, c.begin + c.extra)
            return pa.Table.from_batches([_pack(1, _of_doc(spans.doc, shards), spans)])
        heads, rivals, rest = settle(c)
        r = c.take(rest)
        spans = _united(r.doc, r.begin, r.begin + r.extra + unit.window)
        made = [_pack(1, _of_doc(spans.doc, shards), spans)]
        for kind, which in ((2, (rivals > 1) & (rivals <= CROWD)), (3, rivals > CROWD)):
            h = heads.take(np.flatnonzero(which))
            made.append(_pack(kind, _of_doc(h.doc, shards), h))
        return pa.Table.from_batches(made)

    def shelve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))
        for batch in batches:
            ids = batch.column(doc_id).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            shard = _of_doc(ids.astype(np.int64), shards)
            order = np.argsort(shard, kind="stable")
            own, start = np.unique(shard[order], return_index=True)
            rows = []
            for a, b in zip(start, [*start[1:], len(order)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pack) as w:
                    w.write_batch(batch.take(pa.array(order[a:b])))
                rows.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(rows, pa.binary())], ["shard", "rows"])

    def shelf(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for raw in t.column("rows").to_pylist():
            for batch in pa.ipc.open_stream(raw):
                yield from pieces(batch, text)

    def fetch(shelves: pa.Table, found: pa.Table) -> pa.Table:
        if not found.num_rows:
            return _empty()
        kind = found.column("kind").to_numpy()
        passed = _unpack(found.filter(pc.equal(found.column("kind"), 1)))
        spans = _united(passed.doc, passed.begin, passed.begin + passed.extra)
        made = [pa.Table.from_batches([_pack(1, _of_doc(spans.doc, shards), spans)])]
        sides = [(k, c.take(np.argsort(c.doc, kind="stable"))) for k in (2, 3) if (kind == k).any() for c in [_unpack(found.filter(pc.equal(found.column("kind"), k)))]]
        if not sides:
            return made[0]
        got: list[Contexts] = []
        content: list[bytes] = []
        crowded: list[np.ndarray] = []
        taken = {k: np.zeros(len(c.key), bool) for k, c in sides}
        for part in shelf(shelves):
            data, at = texts(part.column(text))
            symbols, first, start, end = unit.symbols(data, at)
            ids = part.column(doc_id).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = data.tobytes()
            for k, c in sides:
                left, right = np.searchsorted(c.doc, ids), np.searchsorted(c.doc, ids, side="right")
                mine = ragged(left, right - left)
                base, room = np.repeat(first[:-1], right - left), np.repeat(np.diff(first), right - left)
                h = c.take(mine)
                # a context is taken once, from a text that holds it: rows may repeat, and an id have several texts
                held = np.flatnonzero((h.begin + h.extra + unit.window <= room) & ~taken[k][mine])
                begin = h.begin[held] + base[held]
                one, two = symbols.named(begin, begin + h.extra[held] + unit.window)
                held = held[(one == h.ctx[held]) & (two == h.ctx2[held])]
                held = held[np.unique(mine[held], return_index=True)[1]]
                taken[k][mine[held]] = True
                h, base = h.take(held), base[held]
                if k == 3 and len(h.key):
                    number = h.extra + 1
                    w = ragged(h.begin + base, number)
                    h = windows_of(unit, symbols, w, np.repeat(h.doc, number), w - np.repeat(base, number))
                    base = np.repeat(base, number)
                if len(h.key):
                    i = start[h.begin + base]
                    j = end[h.begin + base + h.extra + unit.window - 1]
                    content += [raw[x:y] for x, y in zip(i.tolist(), j.tolist())]
                    got.append(h)
                    crowded.append(np.full(len(h.key), k == 3))
        if not got:
            return made[0]
        c = Contexts.join(got)
        single = np.flatnonzero(np.concatenate(crowded))  # windows of crowded grams: again only the first of equals
        if len(single):
            heads, _, rest = settle(c.take(single))
            r = c.take(single[rest])
            spans = _united(r.doc, r.begin, r.begin + unit.window)
            made.append(pa.Table.from_batches([_pack(1, _of_doc(spans.doc, shards), spans)]))
            stays = np.ones(len(c.key), bool)
            stays[single[rest]] = False
            index = np.flatnonzero(stays)
            index = index[_once(c.take(index))]
            c, content = c.take(index), [content[k] for k in index]
        made.append(pa.Table.from_batches([_pack(0, _of_key(c.key, gram_shards), c, content)]))
        return pa.concat_tables(made)

    def decide(t: pa.Table) -> pa.Table:
        if t.column("kind")[0].as_py() == 1:
            return t.select(_ARROW.names)
        c = _unpack(t)
        content = t.column("content").combine_chunks().flatten().to_pylist()
        order = np.lexsort((c.begin, c.doc, c.key))
        c = c.take(order)
        alone = np.r_[True, c.key[1:] != c.key[:-1]] & np.r_[c.key[1:] != c.key[:-1], True]
        index = np.flatnonzero(~alone)
        c, content = c.take(index), [content[k] for k in order[index]]
        if not content:
            return _empty()
        number = np.cumsum(np.r_[True, c.key[1:] != c.key[:-1]])
        met = (number[1:] == number[:-1]) & (c.doc[1:] == c.doc[:-1]) & (c.begin[1:] <= c.begin[:-1] + c.extra[:-1])
        several = np.isin(number, number[1:][met])  # texts of one id hold windows at one place: judged by window and place
        doc, begin = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if several.any():
            index = np.flatnonzero(several)
            r = _later_windows(unit, [content[k] for k in index], c.take(index))
            doc, begin = doc + [r.doc], begin + [r.begin]
        if not several.all():
            index = np.flatnonzero(~several)
            h = c.take(index)
            which, window = judge([content[k] for k in index], h.key, h.doc, h.begin, h.extra)
            doc, begin = doc + [h.doc[which]], begin + [h.begin[which] + window]
        doc, begin = np.concatenate(doc), np.concatenate(begin)
        spans = _united(doc, begin, begin + unit.window)
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches([_pack(1, _of_doc(spans.doc, shards), spans)])

    def close(shelves: pa.Table, found: pa.Table) -> pa.Table:
        c = _unpack(found) if found.num_rows else Contexts.none()
        spans = _united(c.doc, c.begin, c.begin + c.extra)
        made = []
        for part in shelf(shelves):
            made.append(_finished(part, spans))
        schema = made[0].schema if made else None
        return pa.Table.from_batches(made, schema)

    def _finished(part: pa.RecordBatch, spans: Contexts) -> pa.RecordBatch:
        data, at = texts(part.column(text))
        first, start, end = unit.places(data, at)
        ids = part.column(doc_id).to_numpy(zero_copy_only=False)
        ids = np.where(np.isnan(ids), -1, ids).astype(np.int64) if ids.dtype.kind == "f" else ids.astype(np.int64)
        left, right = np.searchsorted(spans.doc, ids), np.searchsorted(spans.doc, ids, side="right")
        mine = ragged(left, right - left)
        base, room = np.repeat(first[:-1], right - left), np.repeat(first[1:], right - left)
        edge = np.zeros(first[-1] + 1, np.int64)
        np.add.at(edge, np.minimum(base + spans.begin[mine], room), 1)
        np.add.at(edge, np.minimum(base + spans.begin[mine] + spans.extra[mine], room), -1)
        covered = np.cumsum(edge)[:-1] > 0
        columns = finish(data, at, first, start, end, covered)
        return pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *columns], [*names, *added.names])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = _united(*(np.zeros(0, np.int64) for _ in range(3)))
        for batch in batches:
            for part in pieces(batch, text):
                yield _finished(part, none)

    known = docs.where(F.col(doc_id).isNotNull())
    light = known.select(F.col(doc_id).cast("long").alias(doc_id), text)
    found = light.mapInArrow(scan, _ROWS).groupBy("kind", "shard").applyInArrow(meet, _ROWS)
    shelves = known.withColumn(doc_id, F.col(doc_id).cast(docs.schema[doc_id].dataType)).mapInArrow(shelve, "shard int, rows binary").groupBy("shard")
    found = shelves.cogroup(found.groupBy("shard")).applyInArrow(fetch, _ROWS).groupBy("kind", "shard").applyInArrow(decide, _ROWS)
    done = shelves.cogroup(found.groupBy("shard")).applyInArrow(close, out)
    return done.union(docs.where(F.col(doc_id).isNull()).mapInArrow(whole, out))
