"""Retrieval and judged-answer metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Results that count for a score, and the pipelines compared.
K, CONFIGS = 10, ("bm25", "hyde", "rerank", "rerank_nohyde")
#: Bounds of the overlap bands; only the lower one is published.
LOW, HIGH = 0.30, 0.60
METRICS = ("recall_chunk", "recall_paper", "mrr_chunk", "mrr_paper")


def question_scores(ranked: DataFrame, gold: DataFrame, k: int, query_key: str = "question_id") -> DataFrame:
    """Recall and reciprocal rank of each gold question within the first k. ranked: query_key, rank, chunk_id, arxiv_id; gold: query_key,
    source_chunk_id, gold_paper. A question without ranked rows scores 0; one row per question."""
    hit = ranked.filter(F.col("rank") <= k).join(gold, query_key)
    best = hit.groupBy(query_key).agg(
        F.min(F.when(F.col("chunk_id") == F.col("source_chunk_id"), F.col("rank"))).alias("_c"),
        F.min(F.when(F.col("arxiv_id") == F.col("gold_paper"), F.col("rank"))).alias("_p"),
    )
    rows = gold.select(query_key).distinct().join(best, query_key, "left")
    rr = lambda c: F.coalesce(1.0 / F.col(c), F.lit(0.0))
    return rows.select(
        query_key,
        F.col("_c").isNotNull().cast("double").alias("recall_chunk"),
        F.col("_p").isNotNull().cast("double").alias("recall_paper"),
        rr("_c").alias("mrr_chunk"),
        rr("_p").alias("mrr_paper"),
    )


def config_means(results: DataFrame) -> DataFrame:
    """Mean of each metric by configuration, in long form, 4 digits. Repeated result rows count once."""
    one = results.select("question_id", "config", *METRICS).distinct()
    means = one.groupBy("config").agg(*[F.avg(m).alias(m) for m in METRICS])
    return means.unpivot("config", list(METRICS), "metric", "value").withColumn("value", F.round("value", 4))


def judged_means(rows: DataFrame, metrics: tuple[str, ...] = ("faithfulness", "answer_relevance", "context_precision")) -> DataFrame:
    """Mean over the scored rows, their number and the number of failures of each metric; 0.0 if nothing was scored."""
    aggs = []
    for m in metrics:
        aggs += [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 4).alias(f"{m}_mean"), F.count(m).alias(f"{m}_scored"), F.count_if(F.col(m).isNull()).alias(f"{m}_failed")]
    return rows.agg(*aggs)


def precision(bits: Column) -> Column:
    """Mean of a list of 0 and 1; null for an empty or null list."""
    return F.when(F.size(bits) > 0, F.aggregate(bits, F.lit(0), lambda a, b: a + b) / F.size(bits))


def band(overlap: Column, low: float = LOW, high: float = HIGH) -> Column:
    return F.when(overlap < low, "low").when(overlap < high, "mid").when(overlap.isNotNull(), "high")


def half_width(p: Column, n: Column) -> Column:
    """Half of a 95 % interval of a proportion by the normal approximation."""
    return F.round(1.96 * F.sqrt(p * (1 - p) / n), 6)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Papers, chunks, and papers by the last source that is not null. Two-level, so that a hot paper is pre-aggregated."""
    last = chunks.groupBy("arxiv_id").agg(F.max_by(F.lower(F.trim("source")), F.when(F.col("source").isNotNull(), F.col("chunk_ord"))).alias("_s"), F.count("*").alias("_n"))
    return last.agg(
        F.count("*").alias("papers"),
        F.sum("_n").alias("chunks"),
        F.count_if(F.col("_s") == "latex").alias("latex"),
        F.count_if(F.col("_s") == "pdf").alias("pdf"),
    )
