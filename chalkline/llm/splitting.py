"""Cutting oversized texts at natural boundaries into overlapping pieces.

The text is split by section headings; a part that is still too large by paragraphs, then sentences (and line ends), then words, then characters.
The parts are packed greedily, and each piece after the first starts with the last words of the one before it. Pieces are cuts of the text, so
white space and marks inside them stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chalkline.llm.store import sliced

WORD = re.compile(r"\S+")
#: The places at which each level may cut, coarse to fine; a cut lies at the end of the match.
LEVELS = (
    re.compile(r"\n(?=[ \t]*(?:#{1,6} |={2,6} ?\w|\\(?:sub)*section\b|<h[1-6]\b))"),  # before a heading
    re.compile(r"\n[ \t]*\n\s*"),  # paragraphs
    re.compile(r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])|\n"),  # sentences and lines
)
#: The limit in words by a pattern that Spark evaluates: white space as Python sees it.
WORDS_SQL = r"[^\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+"


@dataclass(frozen=True)
class SplitParams:
    limit: int = 250
    overlap: int = 40
    longest_word: int = 4000  # characters; a longer run without blanks is cut by characters


def _units(text: str, spans: list[tuple[int, int]], lo: int, hi: int, most: int, level: int) -> list[int]:
    """Word numbers at which words lo..hi may be parted, so that no part has more than `most` words, by the coarsest levels that do."""
    if hi - lo <= most:
        return [hi]
    if level == len(LEVELS):
        return [*range(lo + 1, hi + 1)]
    begin, end = spans[lo][0], spans[hi - 1][1]
    cuts, at = [], lo
    for m in LEVELS[level].finditer(text, begin, end):
        while at < hi and spans[at][0] < m.end():
            at += 1
        if lo < at < hi and (not cuts or cuts[-1] < at):
            cuts.append(at)
    out, last = [], lo
    for c in [*cuts, hi]:
        out += _units(text, spans, last, c, most, level + 1)
        last = c
    return out


def split_words(text: str, limit: int, overlap: int, longest: int) -> list[tuple[int, int]]:
    """Character spans of the pieces. At most `limit` words each; a piece starts `overlap` words before the end of the last one."""
    spans = []
    for m in WORD.finditer(text):
        spans += [(i, min(i + longest, m.end())) for i in range(m.start(), m.end(), longest)]
    if len(spans) <= limit:
        return [(0, len(text))]
    overlap = max(0, min(overlap, limit - 1))
    ends = _units(text, spans, 0, len(spans), limit - overlap, 0)
    out, start, last = [], 0, 0
    for i, e in enumerate(ends):
        if i + 1 == len(ends) or ends[i + 1] - start > limit:
            if e - start > limit:  # the last part alone
                raise AssertionError("a part is larger than the limit")
            out.append((spans[start][0], spans[e - 1][1]))
            last, start = e, max(e - overlap, 0)
    assert last == len(spans)
    return out


def split_chars(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """As `split_words`, with the size in characters: words are packed up to the limit, and cut only if one alone exceeds it."""
    if len(text) <= limit:
        return [(0, len(text))]
    overlap = max(0, min(overlap, limit - 1))
    out, start = [], 0
    while True:
        hi = min(start + limit, len(text))
        if hi < len(text):
            floor = start + overlap + 1
            found = next((c[-1] for p in (*LEVELS, re.compile(r"\s+")) if (c := [m.end() for m in p.finditer(text, start, hi) if floor <= m.end() < hi])), hi)
            hi = found
        out.append((start, hi))
        if hi == len(text):
            return out
        start = hi - overlap


def pieces(rows: DataFrame, key: str = "chunk_ord", text: str = "text", p: SplitParams = SplitParams()) -> DataFrame:
    """key, piece, n_pieces, piece_text, piece_words, for every row. A text up to the limit (also null, empty, blank) is one piece, unchanged, and
    never leaves the JVM; only larger texts are cut. Repeated rows are cut each."""
    n = F.coalesce(F.regexp_count(text, F.lit(WORDS_SQL)), F.lit(0))
    counted = rows.select(F.col(key).alias("_k"), F.col(text).alias("_t"), n.alias("_n"))
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, n_pieces int, piece_text string, piece_words int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            keys, no, of, out, words = [], [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = split_words(t, p.limit, p.overlap, p.longest_word)
                for i, (lo, hi) in enumerate(spans):
                    keys.append(k), no.append(i), of.append(len(spans)), out.append(t[lo:hi]), words.append(len(WORD.findall(t[lo:hi])))
            i32 = lambda x: pa.array(x, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), i32(no), i32(of), pa.array(out, pa.string()), i32(words)], [key, "piece", "n_pieces", "piece_text", "piece_words"])

    large = counted.filter(F.col("_n") > p.limit).select("_k", "_t").mapInArrow(cut, schema)
    whole = counted.filter(F.col("_n") <= p.limit).select(F.col("_k").alias(key), F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.col("_t").alias("piece_text"), F.col("_n").cast("int").alias("piece_words"))
    return large.unionByName(whole)


def renumbered(split: DataFrame, rows: DataFrame, block: int = 1024) -> DataFrame:
    """Pieces with arxiv_id, section, section_index and `new_index`: chunk_index continued in order within a section of a paper.

    Rows that deliver the same chunk again get the same numbers. A section of any size is numbered in blocks of chunk_index values: places
    within a block, plus the sum of the blocks before. Null paper, section_index and chunk_index are groups and places of their own.
    """
    keys = ["arxiv_id", "section_index"]
    meta = rows.select("chunk_ord", "arxiv_id", "section", "section_index", "chunk_index")
    per = split.filter(F.col("piece") == 0).select("chunk_ord", "n_pieces").join(meta, "chunk_ord").groupBy(*keys, "chunk_index").agg(F.max("n_pieces").alias("_n"))
    per = per.withColumn("_b", F.coalesce(F.floor(F.col("chunk_index") / block), F.lit(-1)))
    blocks = per.groupBy(*keys, "_b").agg(F.sum("_n").alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("_n").over(W.partitionBy(*keys, "_b").orderBy("chunk_index").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_o", before).drop("_s")
    a, b = per.withColumn("_i", inside).alias("a"), blocks.alias("b")
    same = lambda x, y, names: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in names]
    first = a.join(b, same("a", "b", [*keys, "_b"])).select("a.arxiv_id", "a.section_index", "a.chunk_index", (F.col("_o") + F.col("_i")).alias("_first"))
    out = split.join(meta, "chunk_ord").alias("a").join(first.alias("b"), same("a", "b", [*keys, "chunk_index"]))
    return out.select("a.chunk_ord", "a.arxiv_id", "a.section", "a.section_index", (F.col("_first") + F.col("piece")).cast("bigint").alias("new_index"), "piece", "n_pieces", "piece_words", "piece_text")


