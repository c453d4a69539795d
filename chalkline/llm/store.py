"""Intermediate tables in the folder that all executors share, and ranks within groups of any size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chalkline.sources.files import delete, shared_folder


#: Tables that this process has written.
WRITTEN: list[str] = []


def discard(spark: SparkSession) -> None:
    """Removes the tables written so far, when the results made from them have been stored."""
    while WRITTEN:
        delete(spark, WRITTEN.pop())


def saved(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder: computed once, and no executor's loss makes them be computed again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared folder, for rows that are large and of which each reader takes some columns."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a bounded number of rows, so that what Python holds of them at once stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def most_frequent(df: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows with the largest counts, `limit` at most: as many whole classes of counts (eighths of a power of two) as fit. Only the sizes of the
    classes, a few hundred numbers, come to the driver, so no task sends it its own best rows."""
    size = F.floor(F.log2(F.col(count)) * 8).cast("int")
    rows = df.filter(F.col(count) > 0).groupBy(size.alias("c")).agg(F.count("*").alias("n")).collect()
    least, total = None, 0
    for r in sorted(rows, key=lambda r: -r["c"]):
        total += r["n"]
        if total > limit:
            break
        least = r["c"]
    return df.limit(0) if least is None else df.filter((F.col(count) > 0) & (size >= least))


def rank_in_group(df: DataFrame, keys: list[str], order: list[Column], name: str, bucket: Column, buckets: int = 256) -> DataFrame:
    """1-based place of each row in its group, without a task that holds a group: places within (group, bucket), plus the counts of the
    group's earlier buckets. Bucket is a number from 0 that decides the order first; `order` decides within it."""
    rows = df.withColumn("_b", F.pmod(bucket, F.lit(buckets)).cast("int"))
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.withColumn("_s", F.coalesce(before, F.lit(0))).drop("_c")
    inner = rows.withColumn(name, F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)))
    return inner.join(starts, [*keys, "_b"]).withColumn(name, F.col(name) + F.col("_s")).drop("_b", "_s")


def sum_before(df: DataFrame, keys: list[str], value: str, order: list[Column], name: str, bucket: Column, buckets: int = 256) -> DataFrame:
    """Sum of a value over the rows before each row of its group, without a task that holds a group: sums within (group, bucket), plus those of
    the group's earlier buckets."""
    rows = df.withColumn("_b", F.pmod(bucket, F.lit(buckets)).cast("int"))
    past = lambda of, by, at: F.coalesce(F.sum(of).over(W.partitionBy(*by).orderBy(*at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy(*keys, "_b").agg(F.sum(value).alias("_c")).withColumn("_s", past("_c", keys, ["_b"])).drop("_c")
    return rows.withColumn(name, past(value, [*keys, "_b"], order)).join(starts, [*keys, "_b"]).withColumn(name, F.col(name) + F.col("_s")).drop("_b", "_s")
