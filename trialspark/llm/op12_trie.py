"""Prefix trie of conversations, folded from its deepest level up by time-forward processing.

A node is a different sequence of first turns (role and text); its members are the conversations that begin with it.
Every node gets its members, children, the childless nodes below it and the tokens (bytes) that sharing saves there.

1. Turns are numbered by `ranks` and named by a cryptographic hash. A conversation's prefixes are a chain of hashes, made
   in blocks of BLOCK turns that are dealt out on their own, so one conversation may hold any share of the rows; then
   over the ends of blocks. 128 bits name a prefix.
2. Members are counted by one aggregation. A node of n members is of class 0 up to LIMIT, 1 up to LIMIT ** 2, and so on.
   Members only get fewer on the way down, so the nodes of a class form subtrees, the shards: a shard's root has a
   parent of a higher class. No level of a shard has more than LIMIT nodes.
3. Within shards, class by class: nodes are sorted (by Spark, on disk) in reverse level order and streamed. A node takes
   the totals that its children have sent out of a priority queue, and sends its own to its parent, later in the order.
   The queue spills sorted runs to an unnamed file of its task if it ever grows. Then across shard roots: their totals
   are summed by parent and enter the next class's shards from below.

A conversation that ends in a node is listed there by number. Lists are cut into chunks in sorted order on many tasks
and hashed chunk after chunk, so that of a node where a third of all conversations end only the chunks meet.

Rows: a null role or text counts as empty, a null turn comes first, rows of one conversation and turn are ordered by
the hash of role and text, and repeated rows are turns of their own. Rows without a conversation are left out. Without
any conversation there is no node. Other columns are ignored.

A conversation of very many turns is one shard and streamed by one task; memory stays small.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import save, table
from trialspark.llm.ranks import numbered
from trialspark.llm.sql import crc32

BLOCK = 256
LIMIT = 512
#: Messages a queue holds in memory, and conversations of a chunk of a list.
QUEUE, CHUNK = 65_536, 4096
#: Of the query: conversations that share a first part, and the most turns of it.
FAMILY, SHARED = 5, 9

ORACLE = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, count(*) AS n, {crc32('c')} % {SHARED} AS h FROM t GROUP BY c),
b AS (SELECT v.c, v.h, least(v.h, coalesce(o.n, 0)) AS m FROM v LEFT JOIN v o ON o.c = v.c - v.c % {FAMILY}),
r AS (SELECT b.c, t.p, role, text FROM b JOIN t ON t.c = b.c - b.c % {FAMILY} AND t.p < b.m
  UNION ALL SELECT b.c, b.m + t.p - b.h, role, text FROM b JOIN t ON t.c = b.c AND t.p >= b.h),
q AS (SELECT c, p + 1 AS depth, strlen(text) AS bytes, list([role, text]) OVER (PARTITION BY c ORDER BY p) AS key FROM r
  UNION ALL SELECT c, 0, 0, [] FROM v),
e AS (SELECT c, max(depth) AS l FROM q GROUP BY c),
n AS (SELECT key, min(q.c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(bytes) AS bytes,
  sha256(coalesce(string_agg(CAST(q.c AS VARCHAR), ',' ORDER BY q.c) FILTER (WHERE depth = l), '')) AS ends_sha256 FROM q JOIN e USING (c) GROUP BY key),
k AS (SELECT key[1:depth - 1] AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (key)),
u AS (SELECT *, unnest(range(depth + 1)) AS up FROM a),
s AS (SELECT key[1:up] AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens FROM u GROUP BY 1)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, a.n_convs, a.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM a JOIN s ON s.key = a.key LEFT JOIN a o ON o.depth = a.depth - 1 AND o.key = a.key[1:a.depth - 1]
"""

_KEY, _PARENT = ["k1", "k2"], ["p1", "p2"]
_MESSAGE = struct.Struct("<5q")


class SpillingQueue:
    """A priority queue of five integers; beyond `most` messages it writes the sorted ones to an unnamed file."""

    def __init__(self, most: int = QUEUE):
        self.most, self.heap, self.heads, self.runs = most, [], [], []

    def push(self, message: tuple[int, int, int, int, int]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.most:
            run = tempfile.TemporaryFile()
            run.write(b"".join(_MESSAGE.pack(*m) for m in sorted(self.heap)))
            run.seek(0)
            self.heap = []
            self.runs.append(run)
            self._next(len(self.runs) - 1)

    def _next(self, k: int) -> None:
        raw = self.runs[k].read(_MESSAGE.size)
        if raw:
            heapq.heappush(self.heads, (_MESSAGE.unpack(raw), k))
        else:
            self.runs[k].close()

    def taken(self, place: tuple[int, int, int]) -> Iterator[tuple[int, int]]:
        """What was sent to a place; places are asked for in rising order."""
        while True:
            spilled = bool(self.heads) and (not self.heap or self.heads[0][0] <= self.heap[0])
            if not spilled and not self.heap:
                return
            message = self.heads[0][0] if spilled else self.heap[0]
            if message[:3] != place:
                return
            if spilled:
                _, k = heapq.heappop(self.heads)
                self._next(k)
            else:
                heapq.heappop(self.heap)
            yield message[3], message[4]


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns by place: `conv`, `place` from 0, `total`, `name` (of role and text) and `bytes` of the text."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    name = F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256)
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), name.alias("name"), F.octet_length(text_).cast("long").alias("bytes"))
    placed = numbered(rows, ["conv"], ["turn", "name"], "place", "total", "op12-sorted")
    return save(placed.select("conv", "place", "total", F.unhex("name").alias("name"), "bytes"), "op12-turns")


def _pairs(names: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]


def _hash(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _prefixes(rows: DataFrame, block: int) -> DataFrame:
    """A row for each conversation and prefix: `conv`, `depth`, `bytes`, `ends`, and the names of the node and its parent.

    Within a block a prefix is named by the chain of its turns; behind the first block by the name of the prefix that
    ends the block before, and that.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, name = None, b""
        for batch in batches:
            names, before = [], []
            for conv, place, turn in zip(batch.column("conv").to_pylist(), batch.column("place").to_pylist(), batch.column("name").to_pylist()):
                own = (conv, place // block)
                if own != last:
                    last, name = own, b""
                before.append(name or bytes(16))
                name = _hash(name, turn)
                names.append(name)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("place"), batch.column("bytes"), batch.column("ends"), *_pairs(names), *_pairs(before)],
                ["conv", "place", "bytes", "ends", *_KEY, *_PARENT],
            )

    kept = "conv long, place long, bytes long, ends boolean, k1 long, k2 long, p1 long, p2 long"
    dealt = rows.withColumn("block", F.floor(F.col("place") / block)).repartition("conv", "block").sortWithinPartitions("conv", "place")
    named = save(dealt.select("conv", "place", "name", "bytes", "ends").mapInArrow(chain, kept), "op12-chains")
    first = named.where(F.col("place") < block)

    def over_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, name = None, b""
        for batch in batches:
            names = []
            for conv, own in zip(batch.column("conv").to_pylist(), _bytes(batch, _KEY)):
                name = _hash(name, own) if conv == last else own
                last = conv
                names.append(name)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(batch.column("place").to_numpy() // block + 1), *_pairs(names)], ["conv", "block", "b1", "b2"])

    ends = named.where(F.col("place") % block == block - 1).select("conv", "place", *_KEY).repartition("conv").sortWithinPartitions("conv", "place")
    starts = ends.mapInArrow(over_blocks, "conv long, block long, b1 long, b2 long")

    def behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = _bytes(batch, ["b1", "b2"])
            names = [_hash(a, b) for a, b in zip(start, _bytes(batch, _KEY))]
            parents = [a if b == bytes(16) else _hash(a, b) for a, b in zip(start, _bytes(batch, _PARENT))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "place", "bytes", "ends")), *_pairs(names), *_pairs(parents)], ["conv", "place", "bytes", "ends", *_KEY, *_PARENT])

    later = named.where(F.col("place") >= block).withColumn("block", F.floor(F.col("place") / block)).join(starts, ["conv", "block"])
    return first.unionByName(later.mapInArrow(behind, kept))


def _bytes(batch: pa.RecordBatch, columns: list[str]) -> list[bytes]:
    raw = np.stack([batch.column(c).to_numpy() for c in columns], 1).tobytes()
    return [raw[k : k + 16] for k in range(0, len(raw), 16)]


def _class(members: Column, limit: int) -> Column:
    out, most, k = F.lit(0), limit, 1
    while most < 1 << 62:
        out = F.when(members > most, k).otherwise(out)
        most, k = most * limit, k + 1
    return out


def _forward(nodes: DataFrame, queue: int) -> DataFrame:
    """Totals of the nodes of one class (`k1`, `k2`, `n_leaves`, `saved_tokens`), shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting = None, SpillingQueue(queue)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("s1", "s2", "depth", *_KEY, *_PARENT, "n_children", "value", "in_leaves", "in_saved")]
            leaves_, saved_ = [], []
            for s1, s2, depth, k1, k2, p1, p2, children, value, leaves, saved in zip(*columns):
                if (s1, s2) != shard:
                    shard, waiting = (s1, s2), SpillingQueue(queue)
                leaves, saved = leaves + (children == 0), saved + value
                for a, b in waiting.taken((-depth, k1, k2)):
                    leaves, saved = leaves + a, saved + b
                if (k1, k2) != shard:
                    waiting.push((1 - depth, p1, p2, leaves, saved))
                leaves_.append(leaves)
                saved_.append(saved)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEY), pa.array(leaves_, pa.int64()), pa.array(saved_, pa.int64())], [*_KEY, "n_leaves", "saved_tokens"])

    order = ["s1", "s2", F.desc("depth"), *_KEY]
    return nodes.repartition("s1", "s2").sortWithinPartitions(*order).mapInArrow(run, "k1 long, k2 long, n_leaves long, saved_tokens long")


def _lists(ends: DataFrame, chunk: int) -> DataFrame:
    """SHA-256 of the conversations that end in a node, their numbers in rising order and joined by commas."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, numbers = None, []
        for batch in batches:
            out = []
            for k1, k2, conv in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "conv"))):
                if numbers and ((k1, k2) != last or len(numbers) == chunk):
                    out.append((*last, numbers[0], ",".join(map(str, numbers))))
                    numbers = []
                last = (k1, k2)
                numbers.append(conv)
            yield chunks(out)
        if numbers:
            yield chunks([(*last, numbers[0], ",".join(map(str, numbers)))])

    def chunks(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c, d = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], [*_KEY, "first", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, out = None, None, []
        for batch in batches:
            out = []
            for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "text"))):
                if (k1, k2) != last:
                    if last is not None:
                        out.append((*last, state.hexdigest()))
                    last, state = (k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            yield digests(out)
        if last is not None:
            yield digests([(*last, state.hexdigest())])

    def digests(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], [*_KEY, "ends_sha256"])

    ordered = ends.select(*_KEY, "conv").repartitionByRange(*_KEY, "conv").sortWithinPartitions(*_KEY, "conv")
    cuts = ordered.mapInArrow(cut, "k1 long, k2 long, first long, text string")
    return cuts.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame, lengths: DataFrame, limit: int = LIMIT, block: int = BLOCK, queue: int = QUEUE, chunk: int = CHUNK) -> DataFrame:
    """A row for each node. `rows`: `conv`, `place` from 0, `name`, `bytes`; `lengths`: `conv` and `length`, also of
    conversations without turns."""
    lengths = save(lengths, "op12-lengths")
    marked = rows.join(lengths, "conv").select("conv", "place", "name", "bytes", (F.col("place") == F.col("length") - 1).alias("ends"))
    prefixes = save(_prefixes(marked, block).withColumn("depth", F.col("place") + 1), "op12-prefixes")
    inner = prefixes.groupBy(*_KEY).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes")
    )
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = lengths.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("bytes"))
    nodes = inner.unionByName(root)
    nodes = save(nodes.withColumns({"class": _class(F.col("n_convs"), limit), "value": (F.col("n_convs") - 1) * F.col("bytes")}), "op12-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))

    # the shard of a node: where its class begins on the path of its first member
    most = nodes.agg(F.max("class")).first()[0] or 0
    begins = prefixes.join(nodes.select(*_KEY, "class"), _KEY).where(F.col("class") < most).groupBy(F.col("conv").alias("conv_id"), "class")
    begins = begins.agg(F.min(F.struct("depth", *_KEY)).alias("s")).select("conv_id", "class", F.col("s.k1").alias("s1"), F.col("s.k2").alias("s2"))
    shards = nodes.join(begins, ["conv_id", "class"], "left").withColumns({s: F.when(F.col("class") == most, 0).otherwise(F.col(s)) for s in ("s1", "s2")})
    shards = save(shards.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "op12-shards")
    totals = None
    for k in range(most + 1):
        part = shards.where(F.col("class") == k)
        if totals is None:
            part = part.withColumns({"in_leaves": zero, "in_saved": zero})
        else:  # totals of lower shards' roots
            roots = shards.where((F.col("class") < k) & (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))).select(*_KEY, *_PARENT)
            sent = totals.join(roots, _KEY).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("n_leaves").alias("in_leaves"), F.sum("saved_tokens").alias("in_saved"))
            part = part.join(sent, _KEY, "left").fillna(0, ["in_leaves", "in_saved"])
        done = save(_forward(part, queue), "op12-totals")
        totals = done if totals is None else totals.unionByName(done)

    ended = prefixes.where("ends").select(*_KEY, "conv").unionByName(lengths.where("length = 0").select(zero.alias("k1"), zero.alias("k2"), "conv"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = shards.join(totals, _KEY).join(_lists(ended, chunk), _KEY, "left").join(parents, _PARENT, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    )


def trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The nodes of the prefix trie of conversations as they are."""
    rows = turns(conversations, **columns)
    return prefix_trie(rows, rows.groupBy("conv").agg(F.max("total").alias("length")))


def regrafted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with up to h turns of their family's first one, then go on with their own behind h:
    rows and lengths."""
    own = save(rows.groupBy("conv").agg(F.max("total").alias("own")), "op12-own")
    plan = own.withColumns({"h": F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED, "base": F.col("conv") - F.col("conv") % FAMILY})
    plan = plan.join(own.select(F.col("conv").alias("base"), F.col("own").alias("given")), "base", "left").withColumn("m", F.least("h", F.coalesce("given", F.lit(0))))
    plan = save(plan.select("conv", "base", "h", "m", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "op12-plan")
    heads = rows.where(F.col("place") < SHARED - 1).withColumnRenamed("conv", "base").join(plan.select("conv", "base", "m"), "base").where("place < m")
    rest = rows.join(plan.select("conv", "h", "m"), "conv").where("place >= h").withColumn("place", F.col("place") - F.col("h") + F.col("m"))
    columns = ["conv", "place", "name", "bytes"]
    return save(heads.select(columns).unionByName(rest.select(columns)), "op12-rebuilt"), plan.select("conv", "length")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of `conversations`, rebuilt so that families share first turns."""
    return prefix_trie(*regrafted(turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))
