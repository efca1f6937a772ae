"""The corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages
go, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as
Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelake.llm import chunk_dedup, ngram_join, packing, toxicity
from changelake.llm.common import hinted, store, unused
from changelake.llm.queries import table, vocabulary

# Workers still hold what the earlier stages took; the words they keep encoded are fewer here.
REMEMBERED = 80_000
NEAR = ngram_join.Rule(size=5, part=80, over=100)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from labels of ``sf_dir``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(~F.col("rejected")).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones: the one with the smallest doc_id.

    Rows that repeat that document stay once. Different texts of one doc_id are documents of their
    own; rows without a doc_id stay as they are.
    """
    key = F.xxhash64("doc_id", "text")
    node, several = unused(docs, "node", "several")
    given = docs.where("doc_id is not null")
    # Ids that several texts share; each of these texts is linked by its key.
    shared = store(given.groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b")
                   .select("doc_id", F.lit(True).alias(several)), "shared")
    named = given.join(hinted(shared, F.lit(8)), "doc_id", "left").withColumn(
        node, F.when(F.col(several), key).otherwise(F.col("doc_id").cast("long")))
    linked = ngram_join.link(named.select(F.col(node).alias("doc_id"), "text"), NEAR)
    ids = store(named.where(F.col(several)).select(F.col(node).alias("node"), F.col("doc_id").alias("id")).distinct(), "ids")
    kept = (linked.withColumnRenamed("doc_id", "node").join(hinted(ids, F.lit(16)), "node", "left")
            .groupBy("component_id").agg(F.min(F.struct(F.coalesce("id", "node").alias("id"), "node")).alias("least"))
            .select(F.col("least.node").alias(node)))
    one = named.join(kept, node, "left_semi").dropDuplicates([node])
    return one.select(*docs.columns).union(docs.where("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; those left without text go."""
    cut = chunk_dedup.deduplicate(docs)
    left = cut.where("n_removed = 0 or trim(text) <> ''")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
                               .otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4,096 tokens."""
    return packing.pack(docs, vocabulary(), 4096, REMEMBERED)


STAGES = [("toxicity", drop_toxic), ("ngram_join", keep_one_of_near_copies),
          ("substring_dedup", drop_repeated_passages), ("packing", pack)]
# A trained classifier and a tokenizer decide what the rows are; SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each result is stored before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
