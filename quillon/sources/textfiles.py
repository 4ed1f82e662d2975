"""Corpora and query files: tab-separated and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean


def read_corpus_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, text) of a file: blank lines skipped, a missing second column is '', further ones are ignored."""
    parts = spark.read.text(path).filter(F.trim("value") != "").select(F.split("value", "\t").alias("p"))
    return parts.select(F.col("p")[0].alias("doc_key"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("text"))


def read_queries_tsv(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(query_id, gold_id, text): lines of fewer than three columns and unknown gold keys are dropped; of several ids
    with one key in ``keys`` (id, doc_key) the largest stands."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).filter("size(p) >= 3")
    rows = parts.select(F.col("p")[0].alias("query_id"), F.col("p")[1].alias("doc_key"), F.col("p")[2].alias("text"))
    return rows.join(keys.groupBy("doc_key").agg(F.max("id").alias("gold_id")), "doc_key").select("query_id", "gold_id", "text")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_tsv(df: DataFrame, path: str, text_columns: list[str]) -> None:
    """Tab-separated rows; runs of white space within text columns become one blank."""
    df.select(*[clean(F.col(c)).alias(c) if c in text_columns else F.col(c) for c in df.columns]).write.mode("overwrite").option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


def split_orphans(queries: DataFrame, keys: DataFrame, key: str = "gold_key", known: str = "doc_key") -> tuple[DataFrame, DataFrame]:
    """(queries whose key is known, queries whose key is not). A null key is not known."""
    k = keys.select(F.col(known).alias(key)).distinct()
    return queries.join(k, key, "left_semi"), queries.join(k, key, "left_anti")


def numbered(df: DataFrame, order: str, start: int = 0, name: str = "id") -> DataFrame:
    """Consecutive ids by ``order`` without one task holding all rows: places within range partitions, offset by the
    sizes of those before."""
    from ..plans.lineage import written

    rows = written(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "numbered")
    sizes = rows.groupBy("_p").count()
    offset = sizes.select("_p", (F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("count")).alias("_o"))  # one row a partition
    placed = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    return placed.join(F.broadcast(offset), "_p").withColumn(name, F.col("_o") + F.col("_n") - 1 + start).drop("_p", "_o", "_n")
