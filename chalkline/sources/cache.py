"""Read-through cache of expensive results as a table of key and value (JSON), on any file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.sources import files

SCHEMA = "key string, value string"
#: JSON texts that count as empty and are never stored.
EMPTY = ("null", '""', "[]", "{}", "0", "0.0", "false", "")


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path) if files.exists(spark, path) else spark.createDataFrame([], SCHEMA)


def hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (with `key`) and the cached value, null where it is missing. Of a key stored twice the largest value counts."""
    return requests.join(cache.groupBy("key").agg(F.max("value").alias("value")), "key", "left")


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("key"), "key", "left_anti")


def storable(results: DataFrame) -> DataFrame:
    return results.filter(F.col("value").isNotNull() & ~F.trim("value").isin(*EMPTY)).select("key", "value")


def read_through(requests: DataFrame, path: str, compute) -> DataFrame:
    """Every request with its value: compute(misses) gives key and value, each distinct key once; what is not empty is appended to the table.
    What is empty is computed again by the next run, and null here."""
    spark = requests.sparkSession
    new = compute(misses(requests, load(spark, path)).dropDuplicates(["key"]))
    storable(new).write.mode("append").parquet(path)
    return hits(requests, load(spark, path))
