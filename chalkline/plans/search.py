"""Ranked retrieval as one plan for a whole batch of questions: BM25 pool, diversity cap, and only then the text of what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.operators import bm25, ranking
from chalkline.sources import files

#: Chunks that a search ranks, chunks of a paper that it keeps, and rows that it returns.
POOL, PER_PAPER, TOP = 100, 2, 10
RESULT = ("chunk_id", "arxiv_id", "title", "section", "source", "abs_url", "text")


def pool(chunks: DataFrame, queries: DataFrame, n: int, query_key: str = "query_id", index: bm25.Index | None = None) -> DataFrame:
    """query_key, chunk_ord, score, rank of the n best chunks; filled up by chunk_ord where fewer score."""
    return bm25.best(queries, index or bm25.build(chunks), n, query_key)


def search(chunks: DataFrame, queries: DataFrame, n: int = POOL, per_paper: int = PER_PAPER, top: int = TOP, query_key: str = "query_id", index: bm25.Index | None = None) -> DataFrame:
    papers = chunks.select("chunk_ord", "arxiv_id")
    got = pool(chunks, queries, n, query_key, index).join(papers, "chunk_ord")
    kept = ranking.diversify(got, "arxiv_id", per_paper, top, query_key).drop("arxiv_id")
    return with_provenance(kept, chunks, query_key)


def with_provenance(ranked: DataFrame, chunks: DataFrame, query_key: str = "query_id") -> DataFrame:
    """Result rows: the text is joined after ranking, by chunk_ord."""
    return ranked.join(chunks.select("chunk_ord", *RESULT), "chunk_ord").select(query_key, "rank", F.round("score", 6).alias("score"), "chunk_ord", *RESULT)


def alignment(index: bm25.Index, chunks: DataFrame) -> DataFrame:
    """One row: n_docs of the index, and how many chunk_ord values only the index or only the chunks have."""
    sides = index.lengths.select("chunk_ord", F.lit(1).alias("_i")).unionByName(chunks.select("chunk_ord", F.lit(2).alias("_i"))).groupBy("chunk_ord").agg(F.sum("_i").alias("_i"), F.count_if(F.col("_i") == 1).alias("_n"))
    return sides.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_docs"), F.count_if(F.col("_i") == 1).alias("only_index"), F.count_if(F.col("_i") == 2).alias("only_chunks"))


def check_alignment(index: bm25.Index, chunks: DataFrame) -> None:
    """Raises if index and chunks do not hold the same chunk_ord values."""
    odd = alignment(index, chunks).first()
    if odd["only_index"] + odd["only_chunks"]:
        raise ValueError(f"{odd['only_index']} and {odd['only_chunks']} rows are in only one of index and chunks; rebuild the index")


def save_index(index: bm25.Index, path: str) -> None:
    """Postings by document, written where the texts are read: once, and without a shuffle. Frequencies and weights come from what was just
    written."""
    spark = index.documents.sparkSession
    index.documents.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/documents")
    documents = spark.read.parquet(f"{path}/documents")
    words, _ = bm25.weighed(_postings(documents).groupBy("token").agg(F.count("*").alias("df")), documents.select("chunk_ord", "dl"))
    words.write.mode("overwrite").parquet(f"{path}/vocabulary")
    stats = documents.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    stats.withColumn("avg_idf", spark.read.parquet(f"{path}/vocabulary").agg(F.avg("w")).scalar()).write.mode("overwrite").parquet(f"{path}/stats")


def _postings(documents: DataFrame) -> DataFrame:
    return documents.select("chunk_ord", "dl", F.explode("terms").alias("_p")).select("_p.token", "chunk_ord", "dl", "_p.tf")


def load_index(spark, path: str) -> bm25.Index:
    documents, words, stats = (spark.read.parquet(f"{path}/{n}") for n in ("documents", "vocabulary", "stats"))
    return bm25.Index(_postings(documents), documents.select("chunk_ord", "dl"), bm25.with_floor(words, stats), stats, documents)


def kept_index(spark, source: str, chunks: DataFrame | None = None, refresh: bool = False) -> bm25.Index:
    """The index of a chunk table, from the shared folder; built by the first search and again when the table's files have changed. Its mark is
    written last, so an index of which a run was cut off is built anew."""
    chunks = spark.read.parquet(source) if chunks is None else chunks
    path = f"{files.shared_folder(spark).rstrip('/')}/bm25-documents-{files.fingerprint(spark, source, *map(str, bm25.Weights().__dict__.values()))}"
    if refresh or files.read_text(spark, f"{path}/_mark") != "done":
        save_index(bm25.build(chunks), path)
        files.write_text(spark, f"{path}/_mark", "done")
    return load_index(spark, path)
