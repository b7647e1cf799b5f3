"""A training corpus in five stages: toxic documents out, near copies out, test items out, sources mixed, shards cut."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from tidemark.llm.scratch import free_name, land, scratch_path

TOXIC = 0.3     # documents scored at or above this are rejected
SHARDS = 24


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, does not hold for toxic; empty texts are judged by the intercept."""
    weights = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "_score")
    return toxicity.score(docs, weights, column=score).where(F.col(score) < TOXIC).drop(score)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, similarity of 0.8 or more): the one with the smallest id, of those the one
    with the smallest hash of its text.  Rows count one by one, whatever their ids: repeated ids are rows of their own, null ids
    come after all others.  Documents without words are no copies of each other and stay."""
    row = free_name(docs, "_row")
    landed = land(docs.withColumn(row, F.monotonically_increasing_id()), "copies-rows")
    groups = ngram_join.jaccard_components(landed, key=row, n=5, num=80, den=100).select(row, "component_id")
    order = landed.select(row, F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), row).alias("place"))
    kept = groups.join(order, row).groupBy("component_id").agg(F.min("place").alias("place")).select(F.col(f"place.{row}").alias(row))
    return landed.join(kept, row, "left_semi").select(*docs.columns)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: up to three times, or not at all.  Documents without words stay once."""
    return mixing.repeated_to_targets(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it."""
    where = sharding.byte_shards(docs.select("doc_id", "text"), SHARDS)
    return where.select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", one_of_each),
    ("decontamination", without_test_items),
    ("mixing", mixed),
    ("sharding", sharded),
]
ORACLE_SQL = None  # a learned classifier and random rounding have no SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
