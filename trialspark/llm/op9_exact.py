"""Exact dedup by deterministic block naming; DataFrame functions only.

A text, with each run of white space made one space, is cut into blocks of a fixed number of characters. The different
blocks are dealt out by their content, sorted within each task and numbered there: equal blocks, and only those, share
a number (naming needs equals side by side, not one order over all tasks, so no block is sampled to the driver). Pairs
of neighbouring numbers are then sorted and numbered in the same way, level by level, until each document is one
number: its identity, free of collisions because every number stands for content that was compared itself.

Only texts that share a 64-bit fingerprint with another can be equal; the others are their own group and are not
named. Rows are first marked by their fingerprint in a bitmap of FILTER_BITS, which is broadcast (4 MB at any size of
the corpus): a row whose bit is not set is alone, and its text is never shuffled. The others are held against the
shared fingerprints themselves. Blocks and pairs are made distinct before they are sorted, within each task first, so
a text with any number of copies costs little; numbers reach their rows through joins between stored tables, whose
large keys adaptive execution splits. Each level is stored in the shared folder.

Rows: null counts as empty, empty texts are equal. Of equal texts the row with the smallest id stays (rows without an
id come last; of rows that repeat an id one stays). Other columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import save, table

#: Characters of a block.
BLOCK_CHARS = 4096
#: Bits of the bitmap of shared fingerprints; a power of two. It costs time if too small, never a result.
FILTER_BITS = 1 << 25

ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


def one_space(text: str) -> Column:
    """The text with each run of white space made one space (single spaces are left alone)."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _named(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Rows with `name`: the number of their values among the different ones, sorted within a task."""
    ordered = df.select(*columns).distinct().sortWithinPartitions(*columns)
    names = save(ordered.select(*columns, F.monotonically_increasing_id().alias("name")), label)
    return df.join(names, columns)


def _marked(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows with `_maybe`: false for rows whose `_print` is surely none of the shared ones."""
    place = F.pmod("_print", F.lit(FILTER_BITS))
    bits = shared.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    met = rows.withColumns({"_bucket": F.bitmap_bucket_number(place), "_bit": bit}).join(F.broadcast(bits), "_bucket", "left")
    return met.withColumn("_maybe", F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) > 0, F.lit(False))).drop("_bucket", "_bit", "_bits")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK_CHARS) -> DataFrame:
    """Input rows with `keep_id`, `group_size`, `kept` and `text_sha256` (of the text with single spaces)."""
    given = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    printed = docs.select(*given, one_space(text).alias("_one")).withColumn("_print", F.xxhash64("_one"))
    shared = save(printed.groupBy("_print").agg(F.count("*").alias("n")).where("n > 1").select("_print"), "op9-prints")
    marked = _marked(printed, shared)
    met = save(
        marked.where("_maybe").join(shared.withColumn("_shared", F.lit(True)), "_print", "left")
        .select(*given, "_one", F.coalesce("_shared", F.lit(False)).alias("_shared"), F.monotonically_increasing_id().alias("_row")),
        "op9-met",
    )
    digest = F.sha2("_one", 256).alias("text_sha256")
    lone = marked.where("NOT _maybe").select(*given, "_one").unionByName(met.where("NOT _shared").select(*given, "_one"))
    alone = lone.select(*given, F.col(doc_id).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest)
    maybe = met.where("_shared").select(*given, "_one", "_row", digest)

    blocks = F.when(F.col("_one") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("_one", F.lit("(?s).{1,%d}" % block), F.lit(0)))
    cut = maybe.select("_row", F.col(doc_id).alias("_id"), blocks.alias("blocks"))
    cut = cut.select("_row", "_id", F.size("blocks").alias("left"), F.posexplode("blocks").alias("place", "block"))
    level = save(_named(cut, ["block"], "op9-blocks").select("_row", "_id", "left", "place", "name"), "op9-level")
    most = level.agg(F.max("left")).first()[0] or 1
    done, depth = level.where("left = 1").select("_row", "_id", F.lit(0).alias("level"), "name"), 0
    while most > 1:
        depth, most = depth + 1, (most + 1) // 2
        pairs = (
            level.where("left > 1")
            .groupBy("_row", "_id", F.expr("(left + 1) div 2").alias("left"), F.expr("place div 2").alias("place"))
            .agg(F.max(F.expr("if(place % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(place % 2 = 1, name, null)")), F.lit(-1)).alias("b"))
        )
        level = save(_named(pairs, ["a", "b"], "op9-pairs").select("_row", "_id", "left", "place", "name"), "op9-level")
        done = done.union(level.where("left = 1").select("_row", "_id", F.lit(depth).alias("level"), "name"))

    groups = save(
        done.groupBy("level", "name").agg(
            F.count("*").alias("group_size"), F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("first")
        ),
        "op9-groups",
    )
    settled = done.join(groups, ["level", "name"]).select("_row", F.col("first.id").alias("keep_id"), "group_size", (F.col("_row") == F.col("first.row")).alias("kept"))
    found = maybe.join(settled, "_row").select(*given, "keep_id", "group_size", "kept", "text_sha256")
    return alone.unionByName(found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays for it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
