"""The corpus build as one chain: papers with bodies -> sections -> chunks -> filter -> scrub."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.functions.text import reference_like, scrub, tex_body, words
from chalkline.operators import chunking


def normalized(chunks: DataFrame) -> DataFrame:
    """Chunks that are no reference lists or tables, scrubbed. n_words stays as delivered; n_words_norm counts the scrubbed text."""
    kept = chunks.filter(~reference_like(F.col("text"))).withColumn("text", scrub(F.col("text")))
    return kept.withColumn("n_words_norm", F.size(words(F.col("text"))))


def chunked(papers: DataFrame, key: str = "arxiv_id", tex: str = "tex") -> DataFrame:
    bodies = papers.withColumn("_b", tex_body(F.col(tex)))
    return chunking.chunks(chunking.sections(bodies, key, "_b"), key)


def build(papers: DataFrame, key: str = "arxiv_id", tex: str = "tex") -> DataFrame:
    """Narrow throughout: no shuffle from source to normalized chunks."""
    return normalized(chunked(papers, key, tex))
