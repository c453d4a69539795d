"""From sections to overlapping word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.text import noise_section, strip, words

#: Words of a window, words it shares with the next one, and the fewest of a window that is not the first.
SIZE, SHARED, FEWEST = 250, 40, 30
SECTION_MARK = r"\\(?:sub)?section\*?\{([^}]*)\}"


def section_spans(body: Column) -> Column:
    r"""Array of (title, text) cut at \section and \subsection; what stands before the first mark has the title '' and is left out if blank.
    Null gives an empty array."""
    b = F.coalesce(body, F.lit(""))
    titles = F.concat(F.array(F.lit("")), F.regexp_extract_all(b, F.lit(SECTION_MARK), F.lit(1)))
    texts = F.split(b, SECTION_MARK)
    spans = F.zip_with(titles, texts, lambda t, x: F.struct(t.alias("title"), F.coalesce(x, F.lit("")).alias("text")))
    indexed = F.transform(spans, lambda s, i: F.struct(s["title"].alias("title"), s["text"].alias("text"), i.alias("i")))
    kept = F.filter(indexed, lambda s: (s["i"] > 0) | (strip(s["text"]) != ""))
    return F.transform(kept, lambda s: F.struct(s["title"].alias("title"), s["text"].alias("text")))


def sections(papers: DataFrame, key: str, body: str) -> DataFrame:
    """One row per section that has text and no noise title; numbered after the filter, so without gaps."""
    spans = F.filter(section_spans(F.col(body)), lambda s: ~noise_section(s["title"]) & (strip(s["text"]) != ""))
    # the outer form: for the inner one Spark would work out the sections a second time, in a filter in front
    each = papers.select(key, F.posexplode_outer(spans).alias("section_index", "_s")).filter(F.col("section_index").isNotNull())
    return each.select(key, "section_index", F.col("_s.title").alias("section"), strip(F.col("_s.text")).alias("text"))


def windows(text: Column, size: int = SIZE, shared: int = SHARED, fewest: int = FEWEST) -> Column:
    """Array of word arrays: windows of `size` words, each with `shared` words of the one before. One under `fewest` is left out unless it is the first."""
    return F.transform(window_spans(F.size(words(text)), size, shared, fewest), lambda s: F.slice(words(text), s["start"] + 1, s["n"]))


def window_spans(n: Column, size: int = SIZE, shared: int = SHARED, fewest: int = FEWEST) -> Column:
    """Starts and sizes of the windows over n words."""
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(max(1, size - shared)))).otherwise(F.array().cast("array<int>"))
    spans = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.lit(size), n - s).alias("n")))
    return F.filter(spans, lambda s: (s["start"] == 0) | (s["n"] >= fewest))


def chunks(sections_: DataFrame, paper: str = "arxiv_id") -> DataFrame:
    """Chunks with their id `paper:section_index:chunk_index`, from rows with paper, section_index, section and text."""
    split = sections_.withColumn("_w", words(F.col("text")))
    cut = split.select("*", F.posexplode_outer(window_spans(F.size("_w"))).alias("chunk_index", "_s")).filter(F.col("chunk_index").isNotNull())
    return cut.select(
        F.concat_ws(":", paper, "section_index", "chunk_index").alias("chunk_id"),
        paper,
        "section",
        "section_index",
        "chunk_index",
        F.array_join(F.slice("_w", F.col("_s.start") + 1, F.col("_s.n")), " ").alias("text"),
        F.col("_s.n").alias("n_words"),
    )


