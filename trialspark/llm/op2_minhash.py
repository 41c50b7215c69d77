"""MinHash near-dedup: one-permutation sketches with optimal densification, banded buckets, star-shaped candidates.

Documents whose shingle sets have a similarity (intersection by union) of at least `least` percent are linked; a group
is what links connect.

1. Equal sets are one class, represented by its smallest document; only representatives go on. A set is named by 128
   bits of a cryptographic hash of its shingles' 64-bit hashes, which are mixed from cryptographic ones of the words.
2. Each sketch falls into BANDS buckets. A bucket's smallest document is its centre, and the candidate pairs are the
   star (centre, member): as many as members, whatever the bucket's size. They are confirmed on the full sets, whose
   words themselves are compared.
3. Stars alone could lose a link between two members. Where the members of a centre are still in several components,
   each member x outside the main one is held against the others, unless they are in its component or its distance
   to the centre rules them out: 1 - similarity is a metric, so x and y cannot be linked if their distances to the centre
   differ by more than 1 - least / 100. They are tested in blocks, on full sets; only links are returned. Blocks hold
   neighbours by distance and set size, and two blocks meet only where those ranges allow a link.

So of all pairs that share a bucket no link is lost, and pairs are not listed but tested inside tasks. A pair at the
threshold shares no bucket with probability 5e-7 (`sketches`).

Large stars are cut into blocks of bounded documents and text bytes, on both sides where members meet members; the pairs
of blocks of one star still grow with the square of its size. Equal sets and bucket minima are aggregated
within tasks first; joins that may meet a large key are between stored tables, which adaptive execution splits.

Rows: a document without words is linked with nothing. Rows without an id are their own group, with a null component,
and stay. Rows that repeat an id are one document. Other columns are passed through; result columns replace input
columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.llm.common import pieces, ragged, save, table
from trialspark.llm.graph import components
from trialspark.llm.sketches import BANDS, band_keys, exact_sets, set_names, shingle_sets, sketch

#: Documents of a star that are tested in one place.
BLOCK = 256
#: Text bytes of a block, and how many times BLOCK documents one may hold where members meet members.
BLOCK_BYTES, WIDER = 4 << 20, 4
#: Ids (8 bytes each) that may be broadcast to pick texts; more are joined by a shuffle.
FEW_IDS = 2_000_000


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                value, at = shingle_sets(part.column("text"), words)
                name, other = set_names(value, at)
                number = np.diff(at)
                keys = band_keys(sketch(value, at)).view(np.int64)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(number), pa.array(name), pa.array(other), rows], ["doc", "n", "h", "h2", "keys"])

    return docs.mapInArrow(run, "doc long, n long, h long, h2 long, keys array<long>")


def _tested(left: DataFrame, right: DataFrame, bodies: DataFrame, words: int, least: int, only_links: bool) -> DataFrame:
    """Pairs of a left and a right document of one part of a star, by their full sets, word for word: a, b, similarity, linked.

    With `only_links`, pairs of one component or with distances to the centre too far apart are passed over, and
    only linked pairs are returned.
    """
    room = 1 - least / 100 + 1e-9

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if x.num_rows and y.num_rows:
            (ids_x, far_x, own_x), (ids_y, far_y, own_y) = (tuple(t.column(c).to_numpy() for c in ("doc", "far", "component")) for t in (x, y))
            value, at = exact_sets(pa.chunked_array(x.column("text").chunks + y.column("text").chunks, x.schema.field("text").type), words)
            (value_x, at_x), (value_y, at_y) = (value, at[: x.num_rows + 1]), (value, at[x.num_rows :])
            size_x, size_y = np.diff(at_x), np.diff(at_y)
            for k in np.flatnonzero(size_x > 0):
                take = (ids_y != ids_x[k]) & (size_y > 0)
                if only_links:
                    take &= (own_y != own_x[k]) & (np.abs(far_y - far_x[k]) <= room)
                    take &= (100 * size_y >= least * size_x[k]) & (100 * size_x[k] >= least * size_y)
                take = np.flatnonzero(take)
                if not len(take):
                    continue
                mine = value_x[at_x[k] : at_x[k + 1]]
                theirs = value_y[ragged(at_y[take], size_y[take])]
                found = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                both = np.diff(np.r_[0, np.cumsum(found)][np.r_[0, np.cumsum(size_y[take])]])
                union = size_x[k] + size_y[take] - both
                linked = 100 * both >= least * union
                if only_links:
                    take, both, union, linked = take[linked], both[linked], union[linked], linked[linked]
                out.append((np.full(len(take), ids_x[k]), ids_y[take], both / union, linked))
        a, b, s, linked = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(s, pa.float64()), "linked": pa.array(linked, pa.bool_())})

    x, y = (t.join(bodies, "doc").select(*(F.col(c).alias(c) for c in ("place", "part", "doc", "far", "component", "text"))) for t in (left, right))
    return x.groupBy("place", "part").cogroup(y.groupBy("place", "part")).applyInArrow(run, "a long, b long, similarity double, linked boolean")


def _weighed(members: DataFrame, bodies: DataFrame, most: int) -> DataFrame:
    """Members with `weight`, the share of a block that a document fills."""
    weight = F.greatest(F.coalesce(F.sum("bytes"), F.lit(0)) / BLOCK_BYTES, F.lit(1 / most))
    return members.join(bodies.groupBy("doc").agg(weight.alias("weight")), "doc")


def _in_blocks(members: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of stars dealt to parts of about BLOCK documents or BLOCK_BYTES, and the number of parts of the stars that
    have several."""
    number = F.ceil(F.sum("weight") - 1e-6).cast("int")
    parts = save(_weighed(members, bodies, BLOCK).groupBy("place").agg(number.alias("parts")).where("parts > 1"), "op2-parts")
    dealt = members.join(parts, "place", "left").withColumn("part", F.pmod(F.xxhash64("doc"), F.coalesce("parts", F.lit(1))).cast("int"))
    return dealt, parts


def _met_blocks(mixed: DataFrame, sizes: DataFrame, bodies: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Members outside their star's main component, and all members that they may be linked with, by part: a pair of blocks.

    Members are counted in cells by distance and set size. Neighbouring cells fill a block, a cell that overfills
    one is dealt to several; so a block holds less than about two fills. A star of one block meets itself.
    """
    far, size = F.floor(F.col("far") * 50).alias("f"), F.floor(F.log(F.greatest("low", F.lit(1))) * 8).alias("s")
    rows = _weighed(mixed.join(sizes, "doc"), bodies, WIDER * BLOCK).select("*", (F.col("component") == F.col("main")).alias("inner"), far, size)
    cell = ["place", "inner", "f", "s"]
    cells = rows.groupBy(cell).agg(F.sum("weight").alias("w")).withColumn("own", F.col("inner") & (F.sum("w").over(Window.partitionBy("place")) > 1))
    earlier = Window.partitionBy("place", "own").orderBy("inner", "f", "s").rowsBetween(Window.unboundedPreceding, -1)
    cells = save(cells.withColumn("step", F.floor(F.coalesce(F.sum("w").over(earlier), F.lit(0.0)))), "op2-cells")
    large = F.col("w") > 1
    deal = F.when(large, F.pmod(F.xxhash64("doc"), F.ceil("w"))).otherwise(-1)
    name = F.concat_ws("/", F.col("own").cast("string"), "step", *(F.when(large, F.col(c)).otherwise(-1) for c in ("f", "s")), deal)
    dealt = save(rows.join(cells, cell).select("place", "doc", "far", "component", "main", "low", "high", "own", name.alias("block")), "op2-dealt")
    ends = [F.min("far").alias("near"), F.max("far").alias("far"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("component").alias("c"), F.max("component").alias("d")]
    blocks = dealt.groupBy("place", "block", "own").agg(*ends)
    x, y = (blocks.select("place", *(F.col(c).alias(c + side) for c in blocks.columns[1:])) for side in "xy")
    room = 1 - least / 100 + 1e-9
    once = F.expr("NOT ownx AND (owny OR blockx <= blocky) AND NOT (cx = dx AND cy = dy AND cx = cy)")
    close = (F.col("neary") - F.col("farx") <= room) & (F.col("nearx") - F.col("fary") <= room)
    alike = (100 * F.col("highx") >= least * F.col("lowy")) & (100 * F.col("highy") >= least * F.col("lowx"))
    pairs = save(x.join(y, "place").where(once & close & alike).select("place", "blockx", "blocky", F.concat_ws("|", "blockx", "blocky").alias("part")), "op2-pairs")
    left, right = (dealt.join(pairs.select("place", F.col(c).alias("block"), "part"), ["place", "block"]) for c in ("blockx", "blocky"))
    kept = ["place", "part", "doc", "far", "component"]
    return left.where("component <> main").select(kept), right.select(kept)


def _to_all_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return rows.join(parts, "place", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))


def near_groups(docs: DataFrame, words: int = 5, least: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Input rows with `n_shingles` (set size), `component_id` and `kept` (the group's smallest id is the row's own)."""
    given = [c for c in docs.columns if c not in ("n_shingles", "component_id", "kept")]
    plain = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    sketched = save(_sketched(plain, words), "op2-sketches")
    classes = save(sketched.where("n > 0 AND doc IS NOT NULL").groupBy("h", "h2", "n").agg(F.min("doc").alias("first")), "op2-classes")
    banded = sketched.where("n > 0").join(classes.select(F.col("first").alias("doc")).distinct(), "doc", "left_semi").select("doc", F.explode("keys").alias("key"))
    buckets = save(banded.groupBy("key").agg(F.min("doc").alias("centre"), F.max("doc").alias("last")).where("centre < last").select("key", "centre"), "op2-buckets")
    stars = save(banded.join(buckets, "key").where("doc <> centre").select(F.col("centre").alias("place"), "doc").distinct(), "op2-stars")

    needed = save(stars.select("doc").union(stars.select("place")).distinct(), "op2-needed")
    few = needed.count() <= FEW_IDS
    bodies = save(plain.join(F.broadcast(needed) if few else needed, "doc", "left_semi").withColumn("bytes", F.octet_length("text")), "op2-bodies")
    unknown = {"far": F.lit(0.0), "component": F.col("doc")}
    dealt, parts = _in_blocks(stars.withColumns(unknown), bodies)
    centres = stars.select("place").distinct().withColumn("doc", F.col("place")).withColumns(unknown)
    tested = _tested(_to_all_parts(centres, parts), dealt, bodies, words, least, False)
    tested = save(tested.groupBy("a", "b").agg(F.max("similarity").alias("similarity"), F.max("linked").alias("linked")), "op2-tested")
    links = tested.where("linked").select("a", "b")
    first = components(links)

    # what stars may have missed: members of a centre in different components
    placed = tested.select(F.col("a").alias("place"), F.col("b").alias("doc"), (1 - F.col("similarity")).alias("far"))
    placed = placed.union(tested.select("a", F.col("a").alias("doc"), F.lit(0.0)).distinct())
    placed = save(placed.join(first.withColumnRenamed("node", "doc"), "doc", "left").select("place", "doc", "far", F.coalesce("component", "doc").alias("component")), "op2-placed")
    sizes = placed.groupBy("place", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("place").agg(F.count("*").alias("several"), F.max(F.struct("n", F.negative("component").alias("c"))).alias("m")).where("several > 1")
    mixed = save(placed.join(save(main.select("place", F.negative("m.c").alias("main")), "op2-main"), "place"), "op2-mixed")
    sizes = sketched.groupBy("doc").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left, right = _met_blocks(mixed, sizes, bodies, least)
    more = _tested(left, right, bodies, words, least, True).select("a", "b")
    found = components(links.union(save(more, "op2-more")))

    named = save(classes.join(found.withColumnRenamed("node", "first"), "first", "left").select("h", "h2", "n", F.coalesce("component", "first").alias("component_id")), "op2-named")
    rows = sketched.select("doc", "n", "h", "h2").distinct()
    known = rows.where("n > 0 AND doc IS NOT NULL").join(named, ["h", "h2", "n"]).select("doc", "n", "component_id")
    empty = rows.where("n = 0 AND doc IS NOT NULL").select("doc", "n", F.col("doc").alias("component_id"))
    result = known.union(empty).groupBy("doc").agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id"))
    joined = docs.select(*given, F.col(doc_id).cast("long").alias("_doc")).join(result.withColumnRenamed("doc", "_doc"), "_doc", "left")
    return joined.select(*given, F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), "component_id", F.coalesce(F.col("_doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share four fifths of their pairs of words."""
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2).select("doc_id", "n_shingles", "component_id", "kept")
