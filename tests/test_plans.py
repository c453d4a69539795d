"""Plans: pruning, pushed filters, top-k cut before the shuffle; queries against SQL on a small table; stream against batch."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chalkline.operators import bm25
from chalkline.queries import core
from chalkline.streaming import ingest

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_and_pushes(spark):
    p = plan(core.R.queries["src03_scan_filter"](spark, FOLDER))
    assert "PushedFilters: [" in p and "primary_category" in p and "abstract" not in p.partition("ReadSchema")[2]


def test_top_k_is_cut_before_the_shuffle(spark):
    docs = spark.createDataFrame([(i, "ice melts") for i in range(20)], "chunk_ord bigint, text string")
    q = spark.createDataFrame([("q", "ice")], "query_id string, query string")
    assert "WindowGroupLimit" in plan(bm25.top(bm25.scores(q, bm25.build(docs)), 3))


def test_no_cartesian_product_in_any_plan(spark):
    for name in ("top02_bm25_topk", "top03_search_diverse", "agg08_agg09_question_scores", "src14_manifest_counts", "jon10_question_configs"):
        p = plan(core.R.queries[name](spark, FOLDER))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(core.R.sql))
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.compare import norm

    con = duckdb.connect()
    from pathlib import Path

    for f in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = core.R.queries[name](spark, FOLDER)
    cols = sorted(df.columns)
    rel = con.sql(core.R.sql[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    mine = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=str)
    assert mine == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=str)


@pytest.mark.parametrize("name", ["llm05_answers", "llm07_llm09_cells"])
def test_every_question_is_answered(spark, name):
    chunks, asked = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("chunks_norm", "questions"))
    want = asked.join(chunks, asked.source_chunk_id == chunks.chunk_id, "left_semi").select("question_id").distinct()
    got = core.R.queries[name](spark, FOLDER).select("question_id")
    assert want.count() and sorted(want.collect()) == sorted(got.collect())


def test_gold_reads_no_text(spark):
    p = plan(core.R.queries["agg08_agg09_question_scores"](spark, FOLDER))
    assert "chunk_id:string" in p and "text:string" not in p


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.col("doc_id").cast("string").alias("arxiv_id"), F.col("text").alias("body"))
    src, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    docs.filter("arxiv_id < '5'").write.parquet(src)
    ingest.ingest(spark, src, "arxiv_id string, body string", sink, mark).awaitTermination()
    docs.filter("arxiv_id >= '5' or arxiv_id is null").write.mode("append").parquet(src)
    ingest.ingest(spark, src, "arxiv_id string, body string", sink, mark).awaitTermination()
    got = sorted((r["chunk_id"], r["text"]) for r in spark.read.parquet(sink).collect())
    assert got == sorted((r["chunk_id"], r["text"]) for r in ingest.chunk_stream(docs).collect()) and got


def test_stream_deduplicates_and_counts_late_rows(spark, tmp_path):
    rows = spark.sql("select * from values ('a', timestamp'2024-01-01 01:00'), ('a', timestamp'2024-01-01 02:00'), ('b', timestamp'2024-01-02 01:00') t(chunk_id, ingested_at)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ingest.deduplicated(stream).writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["chunk_id"] for r in spark.table("dedup").collect()) == ["a", "b"]
    q = ingest.late_counts(stream).writeStream.outputMode("complete").format("memory").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("late").collect()) == [1, 2]


def test_stream_over_the_delivered_chunks(spark, tmp_path):
    rows = spark.read.parquet(f"{FOLDER}/chunks_norm.parquet").select("chunk_id", "ingested_at")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ingest.deduplicated(stream, delay="400 days").writeStream.format("memory").queryName("own").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("own").count() == rows.select("chunk_id").distinct().count()


def test_searches_read_the_stored_index_and_no_text(spark):
    for name in ("top02_bm25_topk", "top06_rerank_fill"):
        read = {f.partition("parquet")[0].rpartition("/")[2] if "bm25-" not in f else "index" for f in core.R.queries[name](spark, FOLDER).inputFiles()}
        assert "index" in read and "chunks_norm." not in read, read
