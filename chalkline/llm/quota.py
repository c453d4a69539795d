"""A sample whose category shares match given targets, by the divisor method.

Within a category rows stand in random order (a hash of their id and a seed). Row number r has the priority (r - 0.5) / target; the rows under
the category's floor come first, every category's first row before any second one, then the smallest priorities over all categories, up to the
sample's size. A category that runs out leaves its seats to the others of itself, since theirs are the next priorities. No window holds a group:
places are counted in buckets of the order and the buckets before them are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.store import rank_in_group, saved

#: The section types that are kept; any other counts as 'other'.
TYPES = ("intro", "methods", "results", "discussion", "other")


def section_kind(value: Column) -> Column:
    v = F.lower(F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(v.isin(*TYPES), v).otherwise(F.lit("other"))


def paper_id(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"^arXiv:", ""), r"v[0-9]+$", "")


def in_hash_order(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Place of each row in its group in the order of the hash `_h`, in 256 buckets by its first two digits."""
    return rank_in_group(df, keys, [F.col("_h"), F.col("question_id")], name, F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))


def usable(questions: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """question_set, section_type, question_id, paper, _h and the targets' columns: what may be drawn. One row per question_id, the one
    delivered last (created_at, nulls first); type and paper in normal form; no null question_id, set or paper; at most per_paper of a paper
    within a type of a set. Rows of sets or types without a target are left out."""
    rows = questions.select("question_id", "created_at", "question_set", section_kind(F.col("section_type")).alias("section_type"), paper_id(F.col("arxiv_id")).alias("paper"))
    rows = rows.filter(F.col("question_id").isNotNull())
    last = rows.groupBy("question_id").agg(F.max(F.struct("created_at", "question_set", "section_type", "paper")).alias("_r")).select("question_id", "_r.*")
    known = last.filter(F.col("paper").isNotNull()).join(targets, ["question_set", "section_type"])
    hashed = known.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "question_id")))
    placed = in_hash_order(hashed, ["question_set", "section_type", "paper"], "_p")
    return placed.filter(F.col("per_paper").isNull() | (F.col("_p") <= F.col("per_paper"))).drop("_p", "created_at")


def normal_targets(targets: DataFrame) -> DataFrame:
    """One row per set and type. Null numbers count as 0, a null per_paper as no cap."""
    cols = {"sample_size": 0, "target_share": 0.0, "min_rows": 0}
    return targets.groupBy("question_set", "section_type").agg(*[F.coalesce(F.max(c), F.lit(v)).alias(c) for c, v in cols.items()], F.max("per_paper").alias("per_paper"))


def drawn(rows: DataFrame) -> DataFrame:
    """question_set, section_type, question_id, paper, place, seat: the sample, from `usable` rows. Where a set's floors exceed its size, they are
    served by place, so that no type loses all of its floor to another. A type whose target is 0 gives its floor only."""
    order = in_hash_order(rows, ["question_set", "section_type"], "place").filter(F.col("place") <= F.col("sample_size"))
    target = F.col("target_share") * F.col("sample_size")
    late = F.col("place") > F.col("min_rows")
    priority = F.when(~late, F.col("place").cast("double")).when(target > 0, (F.col("place") - 0.5) / target)
    asked = order.withColumn("_pr", priority).filter(F.col("_pr").isNotNull())
    bucket = F.when(late, 256 + F.least(F.lit(255), F.floor(F.col("_pr") * 128))).otherwise(F.least(F.lit(255), F.floor(F.log2(F.col("place")) * 8))).cast("int")
    seated = rank_in_group(asked, ["question_set"], [late.cast("int"), F.col("_pr"), F.col("section_type"), F.col("place")], "seat", bucket, 512)
    seated = seated.filter(F.col("seat") <= F.col("sample_size"))
    return seated.select("question_set", "section_type", "question_id", "paper", F.col("place").cast("int").alias("place"), F.col("seat").cast("int").alias("seat"))


def sample(questions: DataFrame, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sample, report). The report has a row for every target: wanted (the larger of floor and share x size), usable, drawn; unmet where more is
    wanted than is usable, and short where less was drawn than wanted, also because other types' floors took the seats. Types are judged
    independently. Both come from one draw, which is written to the shared folder. Empty questions give an empty sample and zeros in the
    report; ties in the order are broken by id; other columns are not read."""
    want = normal_targets(targets)
    rows = saved(usable(questions, want, seed))
    got = saved(drawn(rows))
    keys = ["question_set", "section_type"]
    n = rows.groupBy(*keys).agg(F.count("*").alias("usable"))
    d = got.groupBy(*keys).agg(F.count("*").alias("drawn"))
    wanted = F.greatest(F.col("min_rows").cast("double"), F.round(F.col("target_share") * F.col("sample_size"), 6))
    report = want.withColumn("wanted", wanted).join(n, keys, "left").join(d, keys, "left")
    report = report.withColumns({"usable": F.coalesce("usable", F.lit(0)), "drawn": F.coalesce("drawn", F.lit(0))})
    return got, report.select(*keys, "sample_size", "min_rows", "target_share", "wanted", "usable", "drawn", (F.col("wanted") > F.col("usable")).alias("unmet"), (F.col("wanted") > F.col("drawn")).alias("short"))
