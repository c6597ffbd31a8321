"""Documents to packed sequences in five stages, each written as Parquet and read again by the next.

Language identification drops texts without letters and ambiguous ones; toxicity drops documents scored 0.7 or
more; of each group of near duplicates the smallest doc_id stays; personal data is replaced by its kind (and
n_chars follows); packing gives the pieces of the sequences. Rows without a doc_id are near duplicates of none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.llm import langid, near_dup, packing, pii, toxicity
from signflow.llm.common import fold, table, tokenizer_path
from signflow.session import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    model = langid.train(docs, F.coalesce(fold(F.col("doc_id"), 4) != 2, F.lit(True)))
    return langid.predict(docs, model).where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select(COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.coalesce(fold(F.col("doc_id"), 3) != 1, F.lit(True)))
    return toxicity.score(docs, model).where(F.col("score") < 0.7).select(COLUMNS)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    first = near_dup.near_duplicates(docs).where("first").select("doc_id", "text_hash").distinct()
    known = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    one = known.join(first, ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash").agg(F.min(F.struct(COLUMNS[1:])).alias("row"))
    return one.select("doc_id", "row.*").unionByName(docs.where("doc_id is null")).select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    return pii.redact(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("toxicity", toxic), ("n-gram Jaccard join", duplicates), ("PII", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage packs from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
