"""What happens to a ranked list: diversity cap, truncation, merging of a model's order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def diversify(ranked: DataFrame, group: str, per_group: int, top_k: int, query_key: str = "query_id") -> DataFrame:
    """At most per_group rows of a group and top_k of a query, in rank order; the same as walking down the list."""
    within = W.partitionBy(query_key, group).orderBy("rank")
    out = ranked.withColumn("_g", F.row_number().over(within)).filter(F.col("_g") <= per_group).drop("_g")
    return out.withColumn("_k", F.row_number().over(W.partitionBy(query_key).orderBy("rank"))).filter(F.col("_k") <= top_k).drop("rank").withColumnRenamed("_k", "rank")


def rerank_fill(pool: DataFrame, ranked: DataFrame, query_key: str = "query_id", top_k: int | None = None) -> DataFrame:
    """The model's order, then what it left out, by place in the pool. pool: query_key, local_idx and more; ranked: query_key, local_idx,
    model_pos, rerank_score. A repeated index counts at its first place, one outside the pool is dropped."""
    first = ranked.groupBy(query_key, "local_idx").agg(F.min(F.struct("model_pos", "rerank_score")).alias("_m"))
    out = pool.join(first, [query_key, "local_idx"], "left").withColumn("rerank_score", F.coalesce("_m.rerank_score", F.lit(0.0)))
    order = [F.col("_m.model_pos").asc_nulls_last(), F.col("local_idx")]
    out = out.withColumn("rank", F.row_number().over(W.partitionBy(query_key).orderBy(*order))).drop("_m")
    return out if top_k is None else out.filter(F.col("rank") <= top_k)
