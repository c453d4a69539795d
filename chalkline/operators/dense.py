"""Exact inner-product search: query vectors in blocks against all vectors, and a store of vectors in blocks.

Any number of queries is cut into blocks of bounded size (block x dimension floats), numbered by a hash of the query. A task multiplies its slices
of vectors by one block after the other with a matrix product and keeps the best n of each query, so only candidates are shuffled. A block is
fetched by the tasks as one broadcast value; the driver holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chalkline.sources import files

#: Vectors and queries of one product.
SLICE, ROWS = 2048, 256


def top_dense(vectors: DataFrame, queries: DataFrame, n: int, key: str = "vec_id", vec: str = "embedding", block: int = 4096) -> DataFrame:
    """query_id, key, score (6 digits), rank of the n nearest by inner product; ties by key. Null vectors and other lengths than that of the first
    query by id are left out. A task keeps n rows a query, however many batches it reads. Blocks hold about `block` queries each."""
    own = queries.select(F.col(key).alias("query_id"), F.col(vec).alias("_v")).filter(F.col(vec).isNotNull())
    schema = f"query_id bigint, {key} bigint, score double"
    size, first = own.agg(F.count("*"), F.min_by(F.size("_v"), "query_id")).first()
    out = None
    blocks = -(-size // max(1, block))
    for b in range(blocks):
        rows = own.filter((F.size("_v") == first) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect()
        if rows:
            found = _best(vectors, np.array([r["query_id"] for r in rows]), np.array([r["_v"] for r in rows], np.float64), n, key, vec, schema)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _best(vectors: DataFrame, ids: np.ndarray, mat: np.ndarray, n: int, key: str, vec: str, schema: str) -> DataFrame:
    held = vectors.sparkSession.sparkContext.broadcast((ids, mat))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, mat = held.value
        parts = range(0, len(ids), ROWS)
        found = [(np.zeros((len(ids[g : g + ROWS]), 0), np.int64), np.zeros((len(ids[g : g + ROWS]), 0))) for g in parts]
        for batch in batches:
            batch = batch[batch[vec].map(lambda v: v is not None and len(v) == mat.shape[1])]
            for at in range(0, len(batch), SLICE):
                b = batch.iloc[at : at + SLICE]
                v, k = np.stack(b[vec].to_numpy()).astype(np.float64).T, b[key].to_numpy(np.int64)
                for i, g in enumerate(parts):
                    s = np.round(mat[g : g + ROWS] @ v, 6)
                    keys, best = np.hstack([found[i][0], np.broadcast_to(k, s.shape)]), np.hstack([found[i][1], s])
                    order = np.lexsort((keys, -best))[:, :n]  # by score, then by key; of each query
                    found[i] = np.take_along_axis(keys, order, 1), np.take_along_axis(best, order, 1)
        for g, (keys, best) in zip(parts, found):
            yield pd.DataFrame({"query_id": np.repeat(ids[g : g + ROWS], keys.shape[1]), key: keys.ravel(), "score": best.ravel()})

    return vectors.select(key, vec).mapInPandas(score, schema)


def with_blocks(vectors: DataFrame, key: str = "vec_id", block: int = 20000) -> DataFrame:
    return vectors.withColumn("block_id", F.floor(F.col(key) / block).cast("bigint"))


def done_blocks(spark: SparkSession, path: str) -> DataFrame:
    """block_id of the blocks that are in the store; the blocks are folders, so no vector is read."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], "block_id bigint")
    return spark.read.parquet(path).select(F.col("block_id").cast("bigint").alias("block_id")).distinct()


def store(rows: DataFrame, path: str, embed=None, key: str = "vec_id", block: int = 20000) -> int:
    """Adds the blocks that the store does not have yet, embedded by embed(rows); the number of rows written. A run that was cut off is taken up
    again with the blocks that are missing, since a block's folder appears only when its write is committed."""
    spark = rows.sparkSession
    todo = with_blocks(rows, key, block).join(done_blocks(spark, path), "block_id", "left_anti")
    n = todo.count()
    if n:
        (embed(todo) if embed else todo).repartition("block_id").write.mode("append").partitionBy("block_id").parquet(path)
    return n


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All vectors of the store, of all blocks."""
    return spark.read.parquet(path).drop("block_id")


def normalized(vec: Column) -> Column:
    """A vector divided by its length; a zero vector stays."""
    size = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(vec, lambda x: F.when(size > 0, (x / size).cast("float")).otherwise(x))
