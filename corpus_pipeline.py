"""From raw documents to packed batches, in five stages that each write their result.

toxicity, exact dedup, MinHash near-dedup, substring dedup, packing: each stage works on all that its predecessor kept
and returns what it keeps, with the columns of `documents`; the last returns each document's place in a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import op2_minhash, op3_toxicity, op4_substring, op7_packing, op9_exact
from trialspark.llm.common import save, small_batches, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, by a model fitted on the labelled ones among them."""
    small_batches(spark)
    model = op3_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return op3_toxicity.judge(docs, model).where("predicted = 0").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the width of white space, the one with the smallest doc_id."""
    return op9_exact.exact_groups(docs).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked by four fifths of their five-word shingles."""
    small_batches(spark)
    return op2_minhash.near_groups(docs, words=5, least=80).where("kept").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 20-word passages that start earlier. Others are left as they are; n_chars follows the text."""
    small_batches(spark)
    cut = op4_substring.drop_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.select(*(text.alias(c) if c == "text" else size.alias(c) if c == "n_chars" else c for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of each document in a batch of its length bucket."""
    small_batches(spark)
    return op7_packing.pack(save(op7_packing.token_lengths(docs, keep_words=False), "pipeline-lengths"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: SQL has no toxicity model, tokenizer or sketches; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
