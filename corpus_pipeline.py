"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import language_id, mixing, near_join, packing, substring_dedup
from lexiloom.llm._common import settled, written


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (0 to 3 times)."""
    sized = written(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.hash("text", F.lit(3)).alias("_rk")), "mix-sizes")
    took = mixing.copies(sized).select("doc_id", "source", "_rk", "copies")
    # rows alike in doc_id, source and text get the sum of their copies, dealt evenly by count
    took = took.groupBy("doc_id", "source", "_rk").agg(F.sum("copies").alias("_sum"), F.count("*").alias("_rows"))
    x = docs.withColumn("_rk", F.hash("text", F.lit(3)))
    x = x.alias("d").join(took.filter("_sum > 0").alias("t"), F.expr("d.doc_id <=> t.doc_id and d.source <=> t.source and d._rk = t._rk")).select("d.*", "t._sum", "t._rows")
    once = x.filter("_rows = 1").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_sum").cast("int"))))
    many = x.filter("_rows > 1").dropDuplicates(["doc_id", "source", "_rk"]).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_sum").cast("int"))))
    if not took.filter("_rows > 1 and _sum > 0").limit(1).count():
        return once.select(*docs.columns)
    return once.select(*docs.columns).unionByName(many.select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its length, bucket_length, batch_id in the bucket and batch_row in the batch."""
    sized = written(docs.select("doc_id", mixing.word_count(F.col("text")).alias("length")), "pack-sizes")
    return packing.pack(sized).select("doc_id", "length", "bucket_length", "batch_id", "batch_row")


STAGES = [
    ("language", language_id.stage_language),
    ("near_duplicates", near_join.stage_near),
    ("substring_dedup", substring_dedup.stage_substring),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again, and the tables that
    a stage wrote on its way are removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: The language stage is a fitted model, which SQL can't express; tests/llm/test_pipeline_stages.py holds every stage's
#: rows against a brute-force version, with a fixed language model.
ORACLE_SQL = None
