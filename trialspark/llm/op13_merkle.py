"""Merkle manifest of a dataset: every row a leaf, a tree a source, one root, and each row's proof.

H is the lowercase hex SHA-256 of its inputs end to end, digests as hex text. A leaf is H of the row's fields, each `-`
if null, else the number of its UTF-8 bytes, `:` and the value. In a source leaves ascend by id; as long as several
nodes remain, every RUN consecutive ones become their H. What remains is the source's subroot; the subroots, ordered by
source (null first, then bytewise), give the root in the same way.

Cogrouped subtree exchange: RUN ** LEVELS consecutive nodes form a superblock, the unit of exchange. Going up, each
superblock is reduced to its top node; those are the nodes of the next tree, a few hundred times smaller, until every
source has one. Going down, the nodes of a superblock meet the siblings above its top (its required outer nodes) in a
cogroup: the task reduces the block again, joins each node's local siblings with the outer ones to its proof, and folds
the proof. So a row is exchanged three times as a few digests, never with its text, and a group holds one superblock
and a path, however large a source is. Places in a source come from a range partitioning (`ranks`), not from one sorted
task.

Rows: a null id comes first, a null source is a source of its own; rows that agree in all fields are leaves each, in any
order, as they are the same leaf. Empty text is a value of 0 bytes. An empty table has no rows and no root. Only the
fields named are leaves; other columns, whatever their names, are left out of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import save, table
from trialspark.llm.ranks import numbered
from trialspark.llm.sql import crc32

#: Nodes that become one, and levels of a superblock.
RUN, LEVELS = 16, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_ONE_IN = 5



def _oracle(levels: int = 5, tops: int = 3) -> str:
    """SQL with each level spelled out: enough for RUN ** levels rows a source and RUN ** tops sources."""

    def leaf_of(text: str) -> str:
        fields = [text if f == "text" else f for f in FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"

    def climb(name: str, number: int) -> list[str]:
        parts = []
        for k in range(number):
            this = f"{name}{k}"
            parts.append(
                f"{name}{k + 1} AS (SELECT tree, i // {RUN} AS i, (any_value(n) + {RUN - 1}) // {RUN} AS n, "
                f"CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {this} GROUP BY tree, i // {RUN})"
            )
            parts.append(
                f"{name}s{k} AS (SELECT a.tree, a.i, any_value(a.n) AS n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, "
                f"coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r "
                f"FROM {this} a JOIN {this} b ON a.tree = b.tree AND a.i // {RUN} = b.i // {RUN} GROUP BY a.tree, a.i)"
            )
        return parts

    def fold(name: str, number: int, seen: str, start: str) -> list[str]:
        parts, last = [], start
        for k in range(number):
            parts.append(
                f"{seen}{k} AS (SELECT f.* EXCLUDE (h, p, i), CASE WHEN s.n > 1 THEN sha256(s.l || f.h || s.r) ELSE f.h END AS h, f.p || s.l || s.r AS p, f.i // {RUN} AS i "
                f"FROM {last} f JOIN {name}s{k} s ON f.tree = s.tree AND f.i = s.i)"
            )
            last = f"{seen}{k}"
        return parts

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    plain = leaf_of("text")
    return ",\n".join([
        f"WITH d AS (SELECT doc_id, source, {plain} AS leaf, CASE WHEN {crc32('doc_id')} % {TAMPERED_ONE_IN} = 0 THEN {leaf_of(lowered)} ELSE {plain} END AS seen FROM documents)",
        "src AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents))",
        "d0 AS (SELECT d.*, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source)",
        "n0 AS (SELECT tree, i, n, leaf AS h FROM d0)",
        *climb("n", levels),
        f"t0 AS (SELECT 0 AS tree, tree AS i, count(*) OVER () AS n, h FROM n{levels})",
        *climb("t", tops),
        "f AS (SELECT doc_id, leaf, tree AS own, tree, i, seen AS h, '' AS p FROM d0)",
        *fold("n", levels, "f", "f"),
        f"g AS (SELECT doc_id, leaf, own, 0 AS tree, own AS i, h, p FROM f{levels - 1})",
        *fold("t", tops, "g", "g"),
        f"e AS (SELECT g.doc_id, g.leaf, u.h AS subroot, (SELECT h FROM t{tops}) AS root, sha256(g.p) AS proof_sha256, g.h AS folded_root FROM g{tops - 1} g JOIN t0 u ON u.i = g.own)",
    ]) + "\nSELECT *, folded_root = root AS verified FROM e"


ORACLE = _oracle()

_TREE = ["_known", "_name"]
_SIDES = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """A field of a leaf: null and value cannot be taken for each other, nor one field for two."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(encoded(f) for f in fields)), 256)


def _depth(nodes: int) -> int:
    """Levels above `nodes` nodes."""
    depth = 0
    while nodes > 1:
        nodes, depth = -(-nodes // RUN), depth + 1
    return depth


def _reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from the given ones up."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[k : k + RUN])) for k in range(0, len(below), RUN)])
    return out


def _block(name: str = "_place") -> Column:
    return F.floor(F.col(name) / (RUN**LEVELS)).cast("long")


def _up(nodes: DataFrame, label: str) -> DataFrame:
    """The top node of each superblock: the next tree's nodes (`_place`, `_total`, `node`)."""

    def reduce(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_place")
        first = block.iloc[0]
        top = _reduced(block["node"].tolist(), min(LEVELS, _depth(int(first["_total"]))))[-1]
        return pd.DataFrame({"_known": [first["_known"]], "_name": [first["_name"]], "_place": [first["_block"]], "_total": [-(-int(first["_total"]) // RUN**LEVELS)], "node": top})

    blocks = nodes.select(*_TREE, "_place", "_total", "node", _block().alias("_block")).groupBy(*_TREE, "_block")
    return save(blocks.applyInPandas(reduce, "_known boolean, _name string, _place long, _total long, node string"), label)


def _trees(nodes: DataFrame, label: str) -> list[DataFrame]:
    """The nodes, the tops of their superblocks, and so on to one node a tree."""
    levels = [nodes]
    while (levels[-1].agg(F.max("_total")).first()[0] or 1) > 1:
        levels.append(_up(levels[-1], label))
    return levels


def _meet(nodes: DataFrame, outer: DataFrame, schema: str, finish) -> DataFrame:
    """Cogroups of a superblock's nodes and the siblings above its top. finish(block, own, path) gets the block's rows, the
    sides of each row's path inside the block, and those above it."""

    def run(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_place")
        levels = _reduced(block["node"].tolist(), min(LEVELS, _depth(int(block["_total"].iloc[0]))))
        own = []
        for k in range(len(block)):
            sides, at = [], k
            for nodes_ in levels[:-1]:
                begin = at - at % RUN
                sides.append(("".join(nodes_[begin:at]), "".join(nodes_[at + 1 : begin + RUN])))
                at //= RUN
            own.append(sides)
        return finish(block, own, above.iloc[0])

    keys = [*_TREE, "_block"]
    return nodes.withColumn("_block", _block()).groupBy(*keys).cogroup(outer.withColumnRenamed("_place", "_block").groupBy(*keys)).applyInPandas(run, schema)


def _down(nodes: DataFrame, outer: DataFrame, label: str) -> DataFrame:
    """The path to the root of each node: `sides`, from its own run up."""

    def extend(block: pd.DataFrame, own: list, above: pd.Series) -> pd.DataFrame:
        rest = [(s["left"], s["right"]) for s in above["sides"]]
        paths = [[{"left": a, "right": b} for a, b in [*sides, *rest]] for sides in own]
        out = block[[*_TREE, "_place"]].assign(sides=paths, subroot=above["subroot"], root=above["root"])
        return out

    return save(_meet(nodes, outer, f"_known boolean, _name string, _place long, sides {_SIDES}, subroot string, root string", extend), label)


def _top_path(tops: DataFrame) -> DataFrame:
    """An empty path for the one node of a tree."""
    return tops.select(*_TREE, "_place", F.expr(f"cast(array() as {_SIDES})").alias("sides"), F.col("node").alias("subroot"), F.col("node").alias("root"))


def manifest(docs: DataFrame, tampered: Column | None = None, changed: Column | None = None, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row for each input row: id and source, `leaf`, `subroot`, `root`, `proof_sha256` (H of all siblings of the
    path, from the leaf's run up, left to right), `folded_root` and `verified`.

    folded_root is what leaf and siblings fold to; where `tampered` holds, the leaf is that of the text `changed`, as
    a reader of altered data would have it, while its siblings are the original ones.
    """
    columns = {f: F.col(f) for f in fields}
    altered = columns | {text: F.col(text) if changed is None else changed}
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    node = leaf(list(columns.values()))
    rows = docs.select(
        F.col(doc_id).alias("id"), F.col(source).isNotNull().alias("_known"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_name"),
        node.alias("node"), F.when(tampered, leaf(list(altered.values()))).otherwise(node).alias("seen"),
    )
    # ids travel as text: a null among numbers would make them floating ones in pandas
    leaves = save(numbered(rows, _TREE, ["id", "node"], "_place", "_total", "op13-sorted").withColumn("id", F.col("id").cast("string")), "op13-leaves")
    trees = _trees(leaves, "op13-tree")
    one = F.lit(True).alias("_known"), F.lit("").alias("_name")
    names = trees[-1].select(F.col("_known").alias("known"), F.col("_name").alias("name"), "node")
    roots = save(numbered(names.select(*one, "known", "name", "node"), _TREE, ["known", "name"], "_place", "_total", "op13-subroots"), "op13-roots")
    tops = _trees(roots, "op13-top")
    path = _top_path(tops[-1])
    for nodes in reversed(tops[:-1]):
        path = _down(nodes, path, "op13-path")
    # a subroot's path in the tree of sources goes on above its own tree's top
    path = roots.join(path.select("_place", "sides", "root"), "_place").select(F.col("known").alias("_known"), F.col("name").alias("_name"), F.lit(0).cast("long").alias("_place"), "sides", F.col("node").alias("subroot"), "root")
    for nodes in reversed(trees[1:-1]):
        path = _down(nodes, path, "op13-path")

    def fold(block: pd.DataFrame, own: list, above: pd.Series) -> pd.DataFrame:
        rest = [(s["left"], s["right"]) for s in above["sides"]]
        shared = "".join(a + b for a, b in rest)
        proof, folded = [], []
        for seen, sides in zip(block["seen"], own):
            proof.append(digest("".join(a + b for a, b in sides) + shared))
            for a, b in [*sides, *rest]:
                seen = digest(a + seen + b)
            folded.append(seen)
        out = block[["id", "_known", "_name"]].assign(leaf=block["node"], subroot=above["subroot"], root=above["root"], proof_sha256=proof, folded_root=folded)
        return out.assign(verified=out["folded_root"] == out["root"])

    kind = rows.schema["id"].dataType.simpleString()
    schema = "id string, _known boolean, _name string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    done = _meet(leaves, path, schema, fold)
    return done.select(F.col("id").cast(kind).alias(doc_id), F.when(F.col("_known"), F.col("_name")).alias(source), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def lower_ascii_letters(text: str) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.col(text), letters, letters.lower())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of `documents`, held against a copy in which every fifth text has lost its capitals."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_ONE_IN == 0
    return manifest(docs, tampered, lower_ascii_letters("text")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
