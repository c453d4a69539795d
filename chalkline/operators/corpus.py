"""Choice of a corpus from paper metadata: normal form, filter, enrichment, gate, selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chalkline.functions.text import strip, words


@dataclass(frozen=True)
class Scope:
    """Which papers belong to the corpus; the values are fixed."""

    categories: tuple[str, ...] = ("physics.ao-ph", "physics.geo-ph")
    not_led_by: tuple[str, ...] = ("astro-ph", "physics.space-ph")
    naming: tuple[str, ...] = ("climate", "warming", "atmospher", "ocean", "carbon", "emission", "precipitation", "temperature", "sea level", "greenhouse", "aerosol", "monsoon", "cyclone", "reanalysis")
    years: tuple[int, int] = (2015, 2026)


#: Citations that a paper needs unless it is recent, the year from which it is (a parameter, so that a result does not depend on
#: today's date), and the papers of a corpus.
CITED, RECENT, PAPERS = 3, 2024, 3000


def paper_date(stamp: Column) -> Column:
    """First ten characters of a date, timestamp or string; null gives ''."""
    return F.coalesce(F.substring(stamp.cast("string"), 1, 10), F.lit(""))


def year_of(stamp: Column) -> Column:
    """Year of a date string; 0 if its first four characters are no number."""
    y = F.substring(paper_date(stamp), 1, 4)
    return F.when(y.rlike("^[0-9]{4}$"), y.cast("int")).otherwise(F.lit(0))


def snapshot_rows(raw: DataFrame) -> DataFrame:
    """Candidates from a raw snapshot with `id`, `categories` as one string with blanks, and `update_date`. Null categories give an empty list."""
    cats = words(F.col("categories"))
    return raw.select(
        F.col("id").alias("arxiv_id"),
        strip(F.coalesce("title", F.lit(""))).alias("title"),
        strip(F.coalesce("abstract", F.lit(""))).alias("abstract"),
        "authors",
        F.get(cats, F.lit(0)).alias("primary_category"),
        cats.alias("categories"),
        F.nullif(paper_date(F.col("update_date")), F.lit("")).alias("published"),
        "license",
        F.concat(F.lit("https://arxiv.org/abs/"), "id").alias("abs_url"),
        F.concat(F.lit("https://arxiv.org/pdf/"), "id").alias("pdf_url"),
    )


def paper_match(scope: Scope = Scope()) -> Column:
    """In a wanted category, not led by an excluded one, within the years, and naming a keyword in title or abstract. Nulls never match a category."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    named = F.lit(not scope.naming)
    for k in scope.naming:
        named = named | text.contains(k)
    first = F.coalesce(F.get("categories", F.lit(0)), F.lit(""))
    excluded = F.lit(False)
    for x in scope.not_led_by:
        excluded = excluded | first.startswith(x)
    inside = F.coalesce(F.arrays_overlap("categories", F.array(*map(F.lit, scope.categories))), F.lit(False))
    return inside & ~excluded & year_of(F.col("published")).between(*scope.years) & named


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the row that comes last in `order` (nulls first). One hash aggregate with partial results, no sort; ties: the largest row
    by its remaining columns, so the result is the same in every run. Rows with a null key form one group."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if not dict(df.dtypes)[c].startswith("map")]))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*")


def enriched(candidates: DataFrame, cache: DataFrame) -> DataFrame:
    """Each candidate once, by its first row in text order, with the last cached lookup; what was never looked up gets defaults."""
    looked = last_by(cache, ["arxiv_id"], [F.col("cached_at")])
    papers = last_by(candidates, ["arxiv_id"], [F.coalesce("published", F.lit(""))])
    return papers.join(looked.drop("cached_at"), "arxiv_id", "left").withColumns(
        {
            "s2_found": F.coalesce("s2_found", F.lit(False)),
            "s2_citations": F.coalesce("s2_citations", F.lit(0)),
            "s2_fields": F.coalesce("s2_fields", F.array().cast("array<string>")),
        }
    )


def gate(cited: int = CITED, recent: int = RECENT) -> Column:
    """Cited often enough or recent; null citations count as 0."""
    return F.lit(cited <= 0) | (F.coalesce("s2_citations", F.lit(0)) >= cited) | (year_of(F.col("published")) >= recent)


def selection(rows: DataFrame, papers: int = PAPERS, cited: int = CITED, recent: int = RECENT) -> DataFrame:
    """The most cited gated papers, then the latest; ties by id. `sel_rank` counts from 1. A sort-limit keeps only that many rows of each task."""
    order = [F.coalesce("s2_citations", F.lit(0)).desc(), F.coalesce("published", F.lit("")).desc(), F.col("arxiv_id")]
    top = rows.filter(gate(cited, recent)).orderBy(*order).limit(papers)
    return top.withColumn("sel_rank", F.row_number().over(W.orderBy(*order)))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the done ones."""
    return rows.join(done.select(key), key, "left_anti")


def corpus_counts(candidates: DataFrame, enriched_rows: DataFrame, selected: DataFrame) -> DataFrame:
    n = enriched_rows.agg(F.count("*").alias("enriched"), F.count_if("s2_found").alias("scholar_found"))
    return n.withColumns({"candidates": candidates.agg(F.count("*")).scalar(), "selected": selected.agg(F.count("*")).scalar()})


