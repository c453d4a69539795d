import gzip
import io
import math
import tarfile

import pytest
from pyspark.sql import functions as F

from chalkline.functions import text
from chalkline.functions.text import STOP_WORDS
from chalkline.operators import bm25, chunking, corpus, dense, metrics, prompts, ranking, sampling
from chalkline.plans import build, models, search
from chalkline.sources import cache, fetch, files, tables


# --- chunking ---


@pytest.mark.parametrize("n, want", [(0, []), (1, [1]), (29, [29]), (210, [210]), (211, [211]), (239, [239]), (240, [240, 30]), (250, [250, 40]), (460, [250, 250, 40])])
def test_window_sizes(spark, n, want):
    text = " ".join(f"w{i}" for i in range(n))
    got = spark.createDataFrame([(text,)], "t string").select(chunking.windows(F.col("t")).alias("w")).first()["w"]
    assert [len(w) for w in got] == want
    assert {w for ws in got for w in ws} == set(text.split())


def test_sections_and_chunks(spark):
    body = r"lead \section{Introduction} one two \subsubsection{kept} \subsection*{Data {x}} three \section{} \section{References} [1]"
    rows = spark.createDataFrame([("p", body), ("q", None), ("r", "no marks"), ("s", " ")], "arxiv_id string, body string")
    got = {(r["arxiv_id"], r["section_index"]): (r["section"], r["text"]) for r in chunking.sections(rows, "arxiv_id", "body").collect()}
    assert got == {
        ("p", 0): ("", "lead"),
        ("p", 1): ("Introduction", r"one two \subsubsection{kept}"),
        ("p", 2): ("Data {x", "} three"),
        ("r", 0): ("", "no marks"),
    }
    ids = [r["chunk_id"] for r in chunking.chunks(chunking.sections(rows, "arxiv_id", "body")).collect()]
    assert sorted(ids) == ["p:0:0", "p:1:0", "p:2:0", "r:0:0"]


def test_small_steps_never_lose_a_word(spark):
    text = " ".join(f"w{i}" for i in range(53))
    got = spark.createDataFrame([(text,)], "t string").select(chunking.windows(F.col("t"), 10, 4, 2).alias("w")).first()["w"]
    assert {w for ws in got for w in ws} == set(text.split())


# --- corpus ---


def test_match_gate_selection(spark):
    rows = spark.createDataFrame(
        [
            ("a", "Ocean", "x", ["physics.ao-ph"], "2015-01-01"),
            ("b", "Ocean", None, ["cs.lg", "physics.geo-ph"], "2026-12-31"),
            ("c", "Ocean", "x", ["astro-ph.ep", "physics.ao-ph"], "2020-01-01"),
            ("d", "Ocean", "x", ["physics.ao-ph"], "2014-12-31"),
            ("e", "Nothing", "x", ["physics.ao-ph"], "2020-01-01"),
            ("f", "Ocean", "x", None, "2020-01-01"),
            ("g", None, "CARBON", ["physics.ao-ph"], "n.d."),
            ("h", None, "CARBON", ["physics.ao-ph"], None),
        ],
        "arxiv_id string, title string, abstract string, categories array<string>, published string",
    )
    assert sorted(r[0] for r in rows.filter(corpus.paper_match()).select("arxiv_id").collect()) == ["a", "b"]
    cited = spark.createDataFrame([("a", 3, "2015"), ("b", 2, "2024-01-01"), ("c", None, None), ("d", 9, None), ("e", 3, "2016")], "arxiv_id string, s2_citations int, published string")
    assert [r["arxiv_id"] for r in corpus.selection(cited, 3).orderBy("sel_rank").collect()] == ["d", "e", "a"]


def test_enriched_takes_the_last_lookup_and_defaults(spark):
    cand = spark.createDataFrame([("a", "t", "2020"), ("a", "t", "2021"), ("b", "t", None)], "arxiv_id string, title string, published string")
    look = spark.sql("select * from values ('a', true, 5, array('x'), null, timestamp'2024-01-01'), ('a', true, 7, array('x'), null, timestamp'2024-02-01') t(arxiv_id, s2_found, s2_citations, s2_fields, s2_tldr, cached_at)")
    got = {r["arxiv_id"]: r for r in corpus.enriched(cand, look).collect()}
    assert got["a"]["s2_citations"] == 7 and got["a"]["published"] == "2021"
    assert (got["b"]["s2_found"], got["b"]["s2_citations"], got["b"]["s2_fields"]) == (False, 0, [])


def test_snapshot_rows(spark):
    raw = spark.createDataFrame([("1", " T ", None, "x", " a b  c ", "2020-05-06T00:00", None), ("2", None, "A", None, None, None, "l")], tables.SNAPSHOT)
    a, b = corpus.snapshot_rows(raw).orderBy("arxiv_id").collect()
    assert (a["title"], a["categories"], a["primary_category"], a["published"]) == ("T", ["a", "b", "c"], "a", "2020-05-06")
    assert (b["title"], b["categories"], b["primary_category"], b["published"]) == ("", [], None, None)


# --- BM25 ---

DOCS = [(0, "ice sheet melts fast"), (1, "ice ice core"), (2, ""), (3, "ice sheet melts fast"), (4, "wind stress field"), (5, None)]


def by_hand(docs, query, p=bm25.Weights()):
    toks = {i: [w for w in (t or "").lower().split() if w not in STOP_WORDS and len(w) > 1] for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else p.epsilon * mean for w, v in idf.items()}
    return {i: round(sum(idf.get(q, 0) * t.count(q) * (p.k1 + 1) / (t.count(q) + p.k1 * (1 - p.b + p.b * len(t) / avg)) for q in query.split()), 6) for i, t in toks.items()}


@pytest.mark.parametrize("query", ["ice melts", "ice ice", "wind", "absent"])
def test_bm25_by_hand(spark, query):
    docs = spark.createDataFrame(DOCS, "chunk_ord bigint, text string")
    got = search.pool(docs, spark.createDataFrame([("q", query)], "query_id string, query string"), 6).orderBy("rank").collect()
    want = sorted(by_hand(DOCS, query).items(), key=lambda x: (-x[1], x[0]))
    assert [(r["chunk_ord"], r["score"]) for r in got] == want


def test_negative_weight_floor(spark):
    docs = [(i, "common " + ("rare" if i == 0 else f"w{i}")) for i in range(5)]
    index = bm25.build(spark.createDataFrame(docs, "chunk_ord bigint, text string"))
    idf = {r["token"]: r["idf"] for r in index.vocabulary.collect()}
    raw = {t: math.log(5 - d + 0.5) - math.log(d + 0.5) for t, d in [("common", 5), ("rare", 1), ("w1", 1), ("w2", 1), ("w3", 1), ("w4", 1)]}
    assert idf["common"] == pytest.approx(0.25 * sum(raw.values()) / 6)


def test_top_edge_cases(spark):
    docs = spark.createDataFrame(DOCS, "chunk_ord bigint, text string")
    q = spark.createDataFrame([("q", "ice")], "query_id string, query string")
    scored = bm25.scores(q, bm25.build(docs))
    assert bm25.top(scored, 0).count() == 0
    with pytest.raises(ValueError):
        bm25.top(scored, -1)
    empty = docs.limit(0)
    assert search.pool(empty, q, 3).count() == 0


def test_pool_with_negative_weights(spark):
    """A document that scores below 0 is not filled in again with 0, and one that shares no token comes before it."""
    docs = [(i, "ice core") for i in range(5)] + [(5, "")]
    want = sorted(by_hand(docs, "ice").items(), key=lambda x: (-x[1], x[0]))[:2]
    assert want[1][1] < 0
    got = search.pool(spark.createDataFrame(docs, "chunk_ord bigint, text string"), spark.createDataFrame([("q", "ice")], "query_id string, query string"), 2).orderBy("rank").collect()
    assert [(r["chunk_ord"], r["score"]) for r in got] == want


def test_pool_in_parts_and_blocks(spark, monkeypatch):
    """Many small blocks and parts of a batch give the rows of the join over all pairs; only n rows a query and task leave a task."""
    words = ("ice", "sheet", "melts", "wind", "stress", "field", "core")
    docs = spark.createDataFrame([(7 * i, " ".join(words[(i * k) % 7] for k in range(1, 2 + i % 5)) + f" w{i % 11}") for i in range(400)], "chunk_ord bigint, text string").repartition(3)
    q = spark.createDataFrame([(i, f"{words[i % 7]} {words[i % 3]} w{i}") for i in range(12)] + [(12, None), (13, "absent")], "query_id int, query string")
    index = bm25.build(docs)
    want = {(r["query_id"], r["chunk_ord"]): r["score"] for r in bm25.top(bm25.scores(q, index), 9).collect()}
    monkeypatch.setattr(bm25, "BATCH_ROWS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        rows = bm25.best(q, index, 9)
        got = {(r["query_id"], r["chunk_ord"]): r["score"] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 14 * 9 and all(got[k] == v for k, v in want.items())
    assert all([k[1] for k in got if k[0] == i] == [7 * j for j in range(9)] for i in (12, 13))
    assert {v for k, v in got.items() if k not in want} == {0.0}
    assert "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()


def test_counted_tokens(spark):
    rows = spark.createDataFrame([(["b", "a", "b", "c", "b"],), (["x"],), ([],)], "t array<string>").select(bm25.counted(F.col("t")).alias("c")).collect()
    assert [[tuple(x) for x in r["c"]] for r in rows] == [[("a", 1), ("b", 3), ("c", 1)], [("x", 1)], []]


def test_index_round_trip_and_alignment(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "chunk_ord bigint, text string")
    search.save_index(bm25.build(docs), str(tmp_path))
    index = search.load_index(spark, str(tmp_path))
    q = spark.createDataFrame([("q", "ice melts")], "query_id string, query string")
    assert search.pool(docs, q, 6, index=index).orderBy("rank").collect() == search.pool(docs, q, 6).orderBy("rank").collect()
    search.check_alignment(index, docs)
    with pytest.raises(ValueError):
        search.check_alignment(index, docs.limit(2))


# --- ranking, dense, sampling ---


def greedy(rows, cap, k):
    seen, out = {}, []
    for i, g in rows:
        if seen.get(g, 0) < cap:
            seen[g] = seen.get(g, 0) + 1
            out.append(i)
        if len(out) == k:
            break
    return out


@pytest.mark.parametrize("cap, k", [(1, 10), (2, 3), (2, 10), (5, 4)])
def test_diversify_is_the_greedy_walk(spark, cap, k):
    rows = [(i, "abcab"[i % 5]) for i in range(12)]
    df = spark.createDataFrame([("q", i, g, i + 1) for i, g in rows], "query_id string, id int, paper string, rank int")
    assert [r["id"] for r in ranking.diversify(df, "paper", cap, k).orderBy("rank").collect()] == greedy(rows, cap, k)


def test_rerank_fill(spark):
    pool = spark.createDataFrame([("q", i) for i in range(4)], "query_id string, local_idx int")
    ranked = spark.createDataFrame([("q", 2, 0, 0.9), ("q", 7, 1, 0.8), ("q", 2, 2, 0.1), ("q", 1, 3, 0.7)], "query_id string, local_idx int, model_pos int, rerank_score double")
    assert [(r["local_idx"], r["rerank_score"]) for r in ranking.rerank_fill(pool, ranked).orderBy("rank").collect()] == [(2, 0.9), (1, 0.7), (0, 0.0), (3, 0.0)]
    assert ranking.rerank_fill(pool, ranked, top_k=2).count() == 2


def test_dense_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(40, None), (41, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = dense.top_dense(df, df.filter("vec_id < 3"), 5).collect()
    f = v.astype(np.float32).astype(float)
    for q in range(3):
        want = sorted(range(40), key=lambda i: (-round(float(f[q] @ f[i]), 6), i))[:5]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert dense.top_dense(df, df.limit(0), 5).count() == 0
    ranked = lambda block: sorted(map(tuple, dense.top_dense(df, df, 5, block=block).collect()))
    whole = ranked(4096)
    assert len(whole) == 40 * 5 and ranked(7) == whole and ranked(1) == whole


def test_vector_store_resumes(spark, tmp_path):
    rows, path, seen = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(4.0).cast("float")).alias("embedding")), str(tmp_path / "v"), []

    def embed(todo):
        seen.append(sorted(r["block_id"] for r in todo.select("block_id").distinct().collect()))
        return todo.withColumn("embedding", dense.normalized(F.col("embedding")))

    assert dense.store(rows.filter("vec_id < 20"), path, embed, block=10) == 20
    assert dense.store(rows, path, embed, block=10) == 30 and dense.store(rows, path, embed, block=10) == 0
    assert seen == [[0, 1], [2, 3, 4]]
    got = dense.stored(spark, path).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == list(range(50)) and got[3]["embedding"] == pytest.approx([0.6, 0.8])


def test_sample_caps_and_balance(spark):
    rows = [(i, f"p{i % 7}", ["Introduction", "Results", "Methods", None][i % 4]) for i in range(200)]
    df = spark.createDataFrame(rows, "chunk_ord bigint, arxiv_id string, section string")
    got = sampling.stratified(df, 12, per_paper=3).collect()
    assert len(got) == 12 and max(sum(r["arxiv_id"] == p for r in got) for p in {r["arxiv_id"] for r in got}) <= 3
    assert sampling.stratified(df, 12, per_paper=3).collect() == got
    assert sampling.stratified(df.limit(0), 5).count() == 0


# --- metrics ---


def test_question_scores(spark):
    ranked = spark.createDataFrame([("a", 1, "x:0:0", "x"), ("a", 2, "y:0:0", "y"), ("a", 3, "y:0:1", "y"), ("b", 1, "z:0:0", "z")], "question_id string, rank int, chunk_id string, arxiv_id string")
    gold = spark.createDataFrame([("a", "y:0:1", "y"), ("b", "q:0:0", "q"), ("c", "q:0:0", "q")], "question_id string, source_chunk_id string, gold_paper string")
    got = {r["question_id"]: tuple(r)[1:] for r in metrics.question_scores(ranked, gold, 10).collect()}
    assert got == {"a": (1.0, 1.0, 1 / 3, 0.5), "b": (0.0,) * 4, "c": (0.0,) * 4}
    assert {r["question_id"]: tuple(r)[1:] for r in metrics.question_scores(ranked, gold, 2).collect()}["a"] == (0.0, 1.0, 0.0, 0.5)


def test_judged_means(spark):
    df = spark.createDataFrame([("a", 1.0, None, 0.5), ("b", 0.5, None, None)], "question_id string, faithfulness double, answer_relevance double, context_precision double")
    r = metrics.judged_means(df).first()
    assert (r["faithfulness_mean"], r["answer_relevance_mean"], r["answer_relevance_failed"], r["context_precision_scored"]) == (0.75, 0.0, 2, 1)
    e = metrics.judged_means(df.limit(0)).first()
    assert e["faithfulness_mean"] == 0.0 and e["faithfulness_scored"] == 0


def test_precision_and_half_width(spark):
    df = spark.createDataFrame([([1, 0, 1],), ([],), (None,)], "b array<int>")
    assert [r[0] for r in df.select(metrics.precision(F.col("b"))).collect()] == [2 / 3, None, None]
    assert spark.range(1).select(metrics.half_width(F.lit(0.3836), F.lit(146))).first()[0] == pytest.approx(0.0789, abs=1e-4)


# --- sources, cache, models ---


def test_jsonl_split_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (2, False)], "id int, kept boolean")
    tables.write_jsonl(df, str(tmp_path / "j"))
    assert tables.read_jsonl(spark, str(tmp_path / "j"), "id int, kept boolean").count() == 2
    tables.write_split(df, "kept", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "kept=true")).count() == 1
    assert tables.write_manifest(str(tmp_path / "m.json"), {"k": 1}, df.agg(F.count("*").alias("n")))["counts"] == {"n": 2}
    assert tables.build_once(spark, str(tmp_path / "b"), lambda: df, fingerprint="1") and not tables.build_once(spark, str(tmp_path / "b"), lambda: df, fingerprint="1")
    assert tables.build_once(spark, str(tmp_path / "b"), lambda: df, fingerprint="2")


def test_fetch_backoff():
    waits, replies = [], iter([(429, b""), OSError(), (503, b""), (200, b"ok")])

    def get(_):
        x = next(replies)
        if isinstance(x, OSError):
            raise x
        return x

    assert fetch.fetch("u", get, sleep=waits.append) == b"ok" and waits == [5, 10, 20]
    assert fetch.fetch("u", lambda _: (404, b""), sleep=waits.append) is None
    waits.clear()
    assert fetch.fetch("u", lambda _: (429, b""), sleep=waits.append) is None and waits == [5, 10, 20, 40, 80, 120]


def archive(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_main_tex():
    blob = archive([("a.tex", b"\\section \\section"), ("b.tex", b"\\documentclass"), ("c.txt", b"\\documentclass \\section")])
    assert fetch.main_tex(blob) == "\\documentclass"
    assert fetch.main_tex(gzip.compress(b"only")) == "only"
    assert fetch.main_tex(b"%PDF-1") is None and fetch.main_tex(b"junk") is None and fetch.main_tex(None) is None and fetch.main_tex(archive([])) is None
    assert fetch.main_tex(archive([("a.tex", b"one"), ("b.tex", b"two")])) == "one"


def test_decoders():
    assert fetch.pdf_text(b"%PDF", lambda b: [" a", "b "]) == "a\nb" and fetch.pdf_text(b"x", lambda b: ["a"]) is None
    assert fetch.pdf_text(b"%PDF", lambda b: 1 / 0) is None
    assert fetch.plain(" x ", lambda r: 1 / 0) == "x" and fetch.plain("x", str.upper) == "X"


def test_batch_lookup_tells_failed_from_missing(spark):
    def lookup(ids):
        if "bad" in ids:
            raise OSError
        return [{"citationCount": 4, "tldr": {"text": "t"}} if i == "a" else None for i in ids]

    df = spark.createDataFrame([("a",), ("b",), ("bad",)], "arxiv_id string").coalesce(1)
    got = {r["arxiv_id"]: (r["status"], r["citations"], r["tldr"]) for r in fetch.batch_lookup(df, lookup, size=2).collect()}
    assert got == {"a": ("found", 4, "t"), "b": ("missing", 0, None), "bad": ("failed", 0, None)}


def test_fallback(spark):
    df = spark.createDataFrame([(["a"], ["b"]), ([], ["b"]), (None, None)], "l array<string>, p array<string>")
    secs, kind = fetch.fallback(F.col("l"), F.col("p"))
    assert [(r[0], r[1]) for r in df.select(secs, kind).collect()] == [(["a"], "latex"), (["b"], "pdf"), (None, "failed")]


def test_cache_reads_through_and_stores_no_empty_result(spark, tmp_path):
    path, calls = str(tmp_path / "kv"), []
    asked = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")

    def compute(miss):
        keys = sorted(r["key"] for r in miss.collect())
        calls.append(keys)
        return miss.sparkSession.createDataFrame([(k, '"v"' if k == "a" else "[]") for k in keys] or [], "key string, value string")

    first = {r["key"]: r["value"] for r in cache.read_through(asked, path, compute).collect()}
    assert first == {"a": '"v"', "b": None} and calls == [["a", "b"]]
    cache.read_through(asked, path, compute)
    assert calls[1] == ["b"]


def test_files_on_any_file_system(spark, tmp_path):
    path = f"file://{tmp_path}/x/y.txt"
    assert files.read_text(spark, path) is None
    files.write_text(spark, path, "grün")
    assert files.read_text(spark, path) == "grün" and files.exists(spark, path)
    mark = files.fingerprint(spark, f"file://{tmp_path}")
    files.write_text(spark, path, "greener")
    assert files.fingerprint(spark, f"file://{tmp_path}") != mark
    files.delete(spark, path)
    assert not files.exists(spark, path)
    assert files.relative("/a//b/./c/d.json", "/a/b/") == "c/d.json" and files.relative("/a", "/a") == ""
    with pytest.raises(ValueError):
        files.relative("/ab/c", "/a")


def test_rescope_keeps_the_lookups(spark, tmp_path):
    folder, asked, ids = str(tmp_path), [], [["a", "b"]]
    scan = lambda: spark.createDataFrame([(i,) for i in ids[0]], "arxiv_id string")

    def look_up(todo):
        asked.append(sorted(r["arxiv_id"] for r in todo.collect()))
        return todo.select("arxiv_id", F.lit(1).alias("n"))

    assert not tables.scoped(spark, folder, scan, look_up)[1].filter("n is null").count()
    ids[0] = ["b", "c"]
    assert not tables.scoped(spark, folder, scan, look_up)[0]
    scanned, rows = tables.scoped(spark, folder, scan, look_up, "rescope")
    assert scanned and sorted(r["arxiv_id"] for r in rows.collect()) == ["b", "c"]
    tables.scoped(spark, folder, scan, look_up, "refresh")
    assert asked == [["a", "b"], [], ["c"], ["b", "c"]]
    with pytest.raises(ValueError):
        tables.scoped(spark, folder, scan, look_up, "all")


def test_kept_index_follows_its_table(spark, tmp_path):
    path = str(tmp_path / "c.parquet")
    spark.createDataFrame(DOCS, "chunk_ord bigint, text string").write.parquet(path)
    assert search.kept_index(spark, path).stats.first()["n_docs"] == len(DOCS)
    spark.createDataFrame([*DOCS, (9, "ice")], "chunk_ord bigint, text string").write.mode("overwrite").parquet(path)
    index = search.kept_index(spark, path)
    search.check_alignment(index, spark.read.parquet(path))
    q = spark.createDataFrame([("q", "ice melts")], "query_id string, query string")
    assert search.pool(spark.read.parquet(path), q, 9, index=index).orderBy("rank").collect() == search.pool(spark.read.parquet(path), q, 9).orderBy("rank").collect()


def fixed(name, reply):
    """A client of one reply; a local class, so that it travels to the tasks."""

    class Client:
        def complete(self, system, prompt):
            return reply

    Client.name = name
    return Client()


def test_expansion_and_guards(spark):
    q = spark.createDataFrame([("a", "Why does ocean heat rise?"), ("b", ""), ("c", None)], "question_id string, question string")
    got = {r["question_id"]: r["query"] for r in models.expanded(q, models.ExpandStub()).collect()}
    assert got == {"a": "Why does ocean heat rise? Why does ocean", "b": " ", "c": ""}
    plain = {r["question_id"]: r["query"] for r in models.expanded(q, fixed("m", "sea ice"), echo=False).collect()}
    assert set(plain.values()) == {"sea ice"}
    df = spark.createDataFrame([("ok", 0), (" ", 0), (None, 0), ("x" * 301, 0), ("ok", 20)], "q string, n int")
    assert [r[0] for r in df.select(prompts.guard(F.col("q"), F.col("n"))).collect()] == ["ok", "blank", "blank", "too_long", "limit"]


def test_replies_are_asked_for_once(spark, tmp_path):
    """A second run takes every reply from the cache, even of a model that would now say something else; another setting asks again."""
    rows = spark.createDataFrame([("a", "p1"), ("b", "p1"), ("c", "p2"), ("d", None)], "id string, prompt string")
    ask = lambda reply, **more: {r["id"]: r["reply"] for r in models.ask(rows, fixed("m", reply), "s", str(tmp_path / "kv"), **more).collect()}
    assert ask("one") == {"a": "one", "b": "one", "c": "one", "d": None}
    assert ask("two") == ask("one") and ask("two", t=1)["a"] == "two"
    assert spark.read.parquet(str(tmp_path / "kv")).count() == 4


def test_rerank_keeps_scores_and_the_models_order(spark):
    pool = spark.createDataFrame([("q", i + 1, f"T{i}", "x", 10 + i) for i in range(4)], "question_id string, rank int, title string, text string, chunk_ord bigint")
    asked = spark.createDataFrame([("q", "ice?")], "question_id string, question string")
    said = 'So: [{"index": 2, "score": 0.1}, {"index": 1, "score": 0.9}, {"index": 2, "score": 1}, {"index": 7, "score": 1}, {"i": 0}, {"index": 0, "score": "high"}]'
    order = lambda reply, top=None: [(r["chunk_ord"], r["rerank_score"]) for r in models.reranked(pool, asked, fixed("m", reply), top).orderBy("rank").collect()]
    assert order(said) == [(12, 0.1), (11, 0.9), (10, 0.0), (13, 0.0)]
    assert order(said, 2) == [(12, 0.1), (11, 0.9)]
    assert order("sorry") == [(10, 0.0), (11, 0.0), (12, 0.0), (13, 0.0)]


def test_answers_and_verdicts(spark):
    context = spark.createDataFrame([("q", 1, "A title", "sea ice", 1)], "question_id string, rank int, title string, text string, chunk_ord bigint")
    asked = spark.createDataFrame([("q", "ice?"), ("r", "wind?")], "question_id string, question string")
    answers = models.answered(context, asked, models.AnswerStub())
    assert {r["question_id"]: r["answer"] for r in answers.collect()} == {"q": "A title [0]", "r": models.REFUSAL}
    verdict = lambda reply: models.judged(answers.filter("question_id = 'q'"), context, fixed("j", reply)).first()[1:]
    assert verdict('{"score": 1.5}') == (1.0, 1.0, None)
    assert verdict('{"score": "many"}') == (0.0, 0.0, None)
    assert verdict('x {"relevant": ["yes", 0, "perhaps"]}') == (None, None, 0.5)
    assert verdict("[1, 1, 0, 0.5]") == (None, None, 0.75)
    assert verdict("none") == (None, None, None)
    with pytest.raises(ValueError):
        models.Clients(models.ExpandStub(), models.RankStub(), models.AnswerStub(), models.AnswerStub())
    with pytest.raises(ValueError):
        models.arm_ranks("dense", asked, context, models.STUBS, 3)


def test_generated_questions(spark):
    assert models.parsed_question('x {"question": " a ", "answer": "b"}') == {"question": "a", "answer": "b"}
    assert models.parsed_question('{"question": "a"}') is None and models.parsed_question('{"question": "a", "answer": " "}') is None and models.parsed_question("[1]") is None
    rows = [("p:0:0", "p", "T", "Data", "Sea ice melts"), ("p:0:1", "p", None, None, "no"), ("p:0:2", "p", "T", None, None), ("p:0:3", "p", "T", None, "Wind stress")]
    chunks = spark.createDataFrame(rows, "chunk_id string, arxiv_id string, title string, section string, text string")
    done = spark.createDataFrame([("p:0:3",)], "source_chunk_id string")
    got = models.generated(chunks, models.AskStub(), done).collect()
    assert [(r["question_id"], r["question"], r["reference_answer"], r["section_type"], r["overlap"]) for r in got] == [("p:0:0", "What is Sea?", "ice", "methods", 1.0)]


def test_listing(spark):
    df = spark.createDataFrame([("q", 2, "T2", "x" * 9, "p2", ""), ("q", 1, None, "abc", "p1", "u1")], "query_id string, rank int, title string, text string, arxiv_id string, abs_url string")
    assert prompts.listing(df, 4).first()["listing"] == "[0] \nabc\n\n[1] T2\nxxxx"
    assert prompts.sources(df).first()["sources"] == "p1 u1\nT2 p2"


def test_build_chain(spark):
    tex = r"\begin{document}\section{Introduction} We see that the flux of it is in the sea and is not all of what was there before <cit.> . \section{References} doi doi doi\end{document}"
    got = build.build(spark.createDataFrame([("p", tex), ("q", None)], "arxiv_id string, tex string")).collect()
    assert len(got) == 1 and got[0]["chunk_id"] == "p:0:0" and got[0]["text"].endswith("there before.") and got[0]["n_words_norm"] == got[0]["n_words"] - 2


def test_top_and_sample_beyond_the_cut_of_spark(spark):
    """A limit above the one for which Spark cuts windows by itself gives the same rows."""
    scored = spark.range(5000).select(F.lit("q").alias("query_id"), F.col("id").alias("chunk_ord"), (F.col("id") % 7).cast("double").alias("score"))
    got = [(r["rank"], r["chunk_ord"]) for r in bm25.top(scored, 1500).orderBy("rank").collect()]
    want = sorted(range(5000), key=lambda i: (-(i % 7), i))[:1500]
    assert got == [(i + 1, c) for i, c in enumerate(want)]
    chunks = spark.range(4000).select(F.col("id").alias("chunk_ord"), F.concat(F.lit("p"), F.col("id") % 3).alias("arxiv_id"), F.lit("Data").alias("section"))
    rows = sampling.stratified(chunks, 2500, 1200).collect()
    assert len(rows) == 2500 and sorted(r["pass"] for r in rows) == list(range(1, 2501))


def test_plain_tex_and_pages(spark):
    df = spark.createDataFrame([(r"\section{A} \textbf{b \emph{c}} 5\% % no" + "\n" + r"$x$~\cite[p]{k} \begin{itemize}\item d\end{itemize}", "<p>a &lt; b</p><script>x</script>c"), (None, None), ("", ""), ("plain", "plain")], "t string, h string")
    got = [tuple(r) for r in df.select(text.plain_tex(F.col("t")), text.page_text(F.col("h"))).collect()]
    assert got == [("A b c 5%\nx\nd", "a < b\nc"), (None, None), ("", ""), ("plain", "plain")]
