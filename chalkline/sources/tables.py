"""Reading and writing of the tables: Parquet for work, JSON lines for exchange, manifests, tables that are built once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from chalkline.sources import files

CHUNKS = "chunk_id string, arxiv_id string, title string, section string, section_index int, chunk_index int, text string, n_words int, source string, license string, abs_url string"
CANDIDATES = "arxiv_id string, title string, abstract string, authors string, primary_category string, categories array<string>, published string, license string, abs_url string, pdf_url string"
QUESTIONS = "question_id string, question string, reference_answer string, source_chunk_id string, arxiv_id string, section string, section_type string, overlap double"
SNAPSHOT = "id string, title string, abstract string, authors string, categories string, update_date string, license string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema, so the file is read once and only the schema's fields are parsed; a malformed line gives a row of nulls."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line; null fields are written, so that a row of nulls stays a row."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_split(df: DataFrame, flag: str, path: str) -> None:
    """One pass over the rows into `flag=true` and `flag=false` below path."""
    df.write.mode("overwrite").partitionBy(flag).parquet(path)


def write_manifest(path: str, settings: dict, counts: DataFrame, root: str | None = None) -> dict:
    """A one-row frame of counts and the settings, as JSON. Settings whose name ends in _path are written relative to root."""
    own = {k: files.relative(v, root) if root and k.endswith("_path") else v for k, v in settings.items()}
    out = {"settings": own, "counts": counts.first().asDict()}
    files.write_text(counts.sparkSession, path, json.dumps(out, indent=2, default=str))
    return out


def built(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return files.exists(spark, f"{path}/_SUCCESS")


def build_once(spark: SparkSession, path: str, make, refresh: bool = False, fingerprint: str = "") -> bool:
    """Write make() to path unless it is there with the same fingerprint; True if it was written."""
    mark = f"{path}/_fingerprint"
    if not refresh and built(spark, path) and (files.read_text(spark, mark) or "") == fingerprint:
        return False
    make().write.mode("overwrite").parquet(path)
    files.write_text(spark, mark, fingerprint)
    return True


def scoped(spark: SparkSession, folder: str, scan, look_up, mode: str = "keep") -> tuple[bool, DataFrame]:
    """(whether the candidates were scanned, candidates with lookups). mode: 'keep' what is there, 'rescope' scans the candidates again but keeps
    the lookups, 'refresh' starts anew. scan() gives candidates; look_up(pending) gives lookups of candidates that have none, which are appended."""
    if mode not in ("keep", "rescope", "refresh"):
        raise ValueError(f"no such mode: {mode}")
    papers, known = f"{folder}/candidates", f"{folder}/enrichment"
    if mode == "refresh":
        files.delete(spark, known)
    scanned = build_once(spark, papers, scan, refresh=mode != "keep")
    rows = spark.read.parquet(papers)
    todo = rows.join(spark.read.parquet(known).select("arxiv_id"), "arxiv_id", "left_anti") if files.exists(spark, known) else rows
    look_up(todo).write.mode("append").parquet(known)
    return scanned, rows.join(spark.read.parquet(known).dropDuplicates(["arxiv_id"]), "arxiv_id", "left")
