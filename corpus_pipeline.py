"""A pipeline over the documents: toxicity filter, exact dedup, near-duplicate dedup, mixing, tokenising.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.  ``run`` writes
each stage's result as Parquet to the shared folder and reads it back as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lagwise.llm.exact_dedup import exact_dedup
from lagwise.llm.mixing import mix_sources
from lagwise.llm.ngram_join import ngram_join
from lagwise.llm.queries import TOXIC, bpe_digests
from lagwise.llm.store import stored
from lagwise.llm.toxicity import labelled_model, score_toxicity

SMALL = 1_000_000  #: dropped rows that may be broadcast (8 MB of numbers)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``; the model learns from the labels of the given documents."""
    model = labelled_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, out="__score").filter(F.col("__score") < TOXIC).select(*docs.columns)


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """``rows`` without those whose ``__uid`` is in ``dropped``, which goes to the texts if it is small, and is joined by key if not."""
    dropped = stored(dropped, "pipeline-dropped")
    return rows.join(F.broadcast(dropped) if dropped.count() <= SMALL else dropped, "__uid", "left_anti")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the largest id (nulls least), of those the last in the stored table.

    Only ids go through the joins of the comparison; the texts stay where they are."""
    rows = docs.withColumn("__uid", F.monotonically_increasing_id())
    marked = exact_dedup(rows.select(F.struct("doc_id", "__uid").alias("__id"), "text"), id_col="__id")
    return _without(rows, marked.filter(~F.col("kept")).select(F.col("__id.__uid").alias("__uid"))).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id (nulls last), of each component of near-duplicates.

    Rows are told apart by their place in the stored table, so rows that share an id are judged each by itself."""
    rows = docs.withColumn("__uid", F.monotonically_increasing_id())
    found = stored(ngram_join(rows.select("__uid", "text"), id_col="__uid", size=5, percent=80).select(F.col("__uid"), "component_id"), "pipeline-near")
    several = found.groupBy("component_id").count().filter("count > 1").select("component_id")
    members = found.join(several, "component_id").join(rows.select("__uid", "doc_id"), "__uid")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__uid")).alias("first"))
    return _without(rows, members.join(first, "component_id").filter("__uid != first.__uid").select("__uid")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; documents of no words are kept once."""
    mixed = mix_sources(docs)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies"))
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of each document that is left, repeats included."""
    return bpe_digests(docs.select("doc_id", "text"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("byte BPE", tokens)]
#: No SQL expresses the classifier, the rounding and the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
