"""Stratified round-robin sample of chunks with a cap per paper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chalkline.functions.text import section_type


#: Questions of an evaluation, chunks of a paper among them, seed, and parts in which a hot paper or type is cut first.
QUESTIONS, PER_PAPER, SEED, PARTS = 150, 1, 42, 64


def first_in(rows: DataFrame, group: str, order: list[str], n: int, name: str, key: str) -> DataFrame:
    """The first n rows of each group with their place, for any n: cut within parts of the group first, so that the last window holds at most PARTS
    times n rows, however many the group has and whether or not Spark cuts a window of this size by itself."""
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    cut = rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS))).withColumn("_c", place(group, "_part")).filter(F.col("_c") <= n)
    return cut.drop("_part", "_c").withColumn(name, place(group)).filter(F.col(name) <= n)


def stratified(chunks: DataFrame, n: int = QUESTIONS, per_paper: int = PER_PAPER, seed: int = SEED, key: str = "chunk_ord") -> DataFrame:
    """n chunks, types in turn, at most per_paper of a paper. The order within is by MD5 of seed and key, so it is the same everywhere."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    rows = chunks.select(key, "arxiv_id", section_type(F.col("section")).alias("section_type"), h.alias("_h"))
    capped = first_in(rows, "arxiv_id", ["_h", key], per_paper, "_p", key)
    drawn = first_in(capped, "section_type", ["_h", key], n, "pass", key).orderBy("pass", "section_type").limit(n)
    return drawn.select(key, "arxiv_id", "section_type", "pass")
