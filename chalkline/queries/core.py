"""Queries for the retrieval and evaluation operators, each with its SQL. Every query reads its whole tables; searches take as queries the
rows whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chalkline.functions import reply, text
from chalkline.operators import bm25, chunking, corpus, dense, metrics, prompts, ranking, sampling
from chalkline.plans import models, search
from chalkline.queries.registry import Registry
from chalkline.sources import cache, fetch, files, tables
from chalkline.streaming import ingest

R = Registry()
C, B = corpus.Scope(), bm25.Weights()


# --- pieces of SQL -------------------------------------------------------------------------------------------------------------------


def _str(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


WS = text.WS
STOPS = ", ".join(_str(w) for w in text.STOP_WORDS)


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{WS}+'), lambda w: w <> '')"


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '{text.TOKEN}'), lambda t: length(t) >= {text.MIN_TOKEN} AND t NOT IN ({STOPS}))"


def sql_stop_fraction(x: str) -> str:
    found = f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z]+')"
    return f"(CASE WHEN len({found}) > 0 THEN len(list_filter({found}, lambda t: t IN ({STOPS})))::DOUBLE / len({found}) ELSE 0.0 END)"


def sql_reference_like(x: str) -> str:
    t = f"coalesce({x}, '')"
    n = lambda of, p: f"len(regexp_extract_all({of}, '{p}'))"
    doi, etal, years = n(f"lower({t})", "doi"), n(f"lower({t})", "et al"), n(t, rf"(?:19|20)[0-9][0-9][a-z]?{WS}*\)")
    words = sql_words(x)
    return (
        f"(CASE WHEN {sql_stop_fraction(x)} >= {text.PROSE} THEN false WHEN {doi} >= {text.DOIS} OR {etal} >= {text.ET_ALS} OR {doi} + {etal} + {years} >= {text.MARKS} THEN true "
        f"WHEN len({words}) > 0 THEN len(list_filter({words}, lambda w: regexp_matches(w, '{text.DIGIT}')))::DOUBLE / len({words}) > {text.TABLE} ELSE false END)"
    )


def sql_scrub(x: str) -> str:
    for pattern, to in text.SCRUB_STEPS:
        x = f"regexp_replace({x}, '{pattern}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return sql_strip(x)


def sql_section_type(x: str) -> str:
    return "(CASE " + " ".join(f"WHEN contains(lower(coalesce({x}, '')), '{k}') THEN '{v}'" for k, v in text.SECTION_KEYS) + " ELSE 'other' END)"


def sql_date(x: str) -> str:
    return f"coalesce(substr({x}::VARCHAR, 1, 10), '')"


def sql_year(x: str) -> str:
    return f"(CASE WHEN regexp_full_match(substr({sql_date(x)}, 1, 4), '[0-9]{{4}}') THEN substr({sql_date(x)}, 1, 4)::INT ELSE 0 END)"


STUB_TAIL = " <cit.> , x ==== y § . § z <g r a p h i c s> ."
LATEST = "latest AS (SELECT * FROM enrichment QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY cached_at DESC NULLS LAST) = 1)"
PAPERS = "papers AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY coalesce(published, '') DESC) = 1)"
ENRICHED = f"{LATEST}, {PAPERS}, enriched AS (SELECT p.*, coalesce(s2_found, false) AS s2_found, coalesce(s2_citations, 0) AS s2_citations, s2_tldr FROM papers p LEFT JOIN latest USING (arxiv_id))"
GATE = f"(s2_citations >= {corpus.CITED} OR {sql_year('published')} >= {corpus.RECENT})"


# --- sources -------------------------------------------------------------------------------------------------------------------------


@R.add("SELECT chunk_id, title, text FROM chunks_norm")
def src01_scan_project(t):
    return t("chunks_norm").select("chunk_id", "title", "text")


@R.add("SELECT chunk_id, title, text FROM chunks_norm")
def src01_src02_json_lines(t):
    """Written as JSON lines once, then scanned with a schema of three of the fields."""
    path = f"{files.shared_folder(t.spark)}/lines-{files.fingerprint(t.spark, t.path('chunks_norm'))}"
    if not tables.built(t.spark, path):
        tables.write_jsonl(t("chunks_norm"), path)
    return tables.read_jsonl(t.spark, path, "chunk_id string, title string, text string")


@R.add("SELECT arxiv_id, published FROM candidates WHERE primary_category = 'physics.ao-ph' AND published >= '2020'")
def src03_scan_filter(t):
    rows = t("candidates").filter((F.col("primary_category") == "physics.ao-ph") & (F.col("published") >= "2020"))
    return rows.select("arxiv_id", "published")


@R.add(f"WITH {ENRICHED} SELECT arxiv_id, s2_found, s2_citations, s2_tldr FROM enriched")
def src04_jon03_enrich_defaults(t):
    return corpus.enriched(t("candidates"), t("enrichment")).select("arxiv_id", "s2_found", "s2_citations", "s2_tldr")


TEX = r"'\documentclass[a]{b} \section{Data} \textbf{We \emph{see}} it~\cite{x1} at 5\% % note' || chr(10) || text || ' \begin{itemize} \item one \end{itemize} $x_1$'"


def sql_tex(x: str) -> str:
    for pattern, to in text.TEX_STEPS:
        x = f"regexp_replace({x}, {_str(pattern)}, {'chr(10)' if to == chr(10) else _str(to.replace('$1', chr(92) + '1'))}, 'g')"
    return sql_strip(x)


@R.add(f"SELECT chunk_ord, md5({sql_tex(TEX)}) AS text FROM chunks_norm")
def src08_plain_tex(t):
    tex = F.concat(F.lit("\\documentclass[a]{b} \\section{Data} \\textbf{We \\emph{see}} it~\\cite{x1} at 5\\% % note\n"), "text", F.lit(" \\begin{itemize} \\item one \\end{itemize} $x_1$"))
    return t("chunks_norm").select("chunk_ord", F.md5(text.plain_tex(tex)).alias("text"))


@R.add(
    "SELECT chunk_ord, CASE WHEN source = 'latex' AND text IS NOT NULL THEN 'latex' WHEN source = 'pdf' AND text IS NOT NULL THEN 'pdf' ELSE 'failed' END AS kind, "
    "CASE WHEN source IN ('latex', 'pdf') THEN text END AS body FROM chunks_norm"
)
def src09_source_fallback(t):
    has = lambda s: F.when((F.col("source") == s) & F.col("text").isNotNull(), F.array("text"))
    secs, kind = fetch.fallback(has("latex"), has("pdf"))
    return t("chunks_norm").select("chunk_ord", kind.alias("kind"), F.get(secs, F.lit(0)).alias("body"))


@R.add("SELECT count(*) AS n_docs, 0::BIGINT AS only_index, 0::BIGINT AS only_chunks FROM chunks_norm")
def src10_index_alignment(t):
    """Rows that only the stored index or only the chunk table has."""
    return search.alignment(_index(t), t("chunks_norm"))


@R.add("SELECT vec_id, vec_id // 128 AS block_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS length2 FROM embeddings")
def src11_src12_set05_vector_store(t):
    """A store of vectors in blocks: two blocks first, as if a run had been cut off, then the rest; read back as one table."""
    path = f"{files.shared_folder(t.spark)}/vectors-{files.fingerprint(t.spark, t.path('embeddings'))}"
    rows = t("embeddings").select("vec_id", "embedding")
    dense.store(rows.filter("vec_id < 256"), path, block=128)
    dense.store(rows, path, block=128)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return dense.with_blocks(dense.stored(t.spark, path), block=128).select("vec_id", "block_id", F.round(square, 4).alias("length2"))


@R.add("SELECT vec_id // 128 AS block_id, count(*) AS n, min(vec_id) AS first_id FROM embeddings GROUP BY 1")
def src12_block_store(t):
    rows = dense.with_blocks(t("embeddings"), block=128)
    return rows.groupBy("block_id").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


@R.add(
    f"SELECT count(*) FILTER (NOT r) AS kept, count(*) FILTER (r) AS dropped, round(100.0 * count(*) FILTER (r) / greatest(count(*), 1), 1) AS pct FROM (SELECT {sql_reference_like('text')} AS r FROM chunks_norm)"
)
def src13_keep_drop_split(t):
    """Also AGG07: both sides of the split are counted in one pass."""
    rows = t("chunks_norm").select(text.reference_like(F.col("text")).alias("r"))
    n = rows.agg(F.count_if(~F.col("r")).alias("kept"), F.count_if("r").alias("dropped"))
    return n.withColumn("pct", F.round(100.0 * F.col("dropped") / F.greatest(F.col("kept") + F.col("dropped"), F.lit(1)), 1))


@R.add(
    f"WITH {ENRICHED} SELECT (SELECT count(*) FROM candidates) AS candidates, count(*) AS enriched, count(*) FILTER (s2_found) AS scholar_found, least(count(*) FILTER ({GATE}), {corpus.PAPERS}) AS selected FROM enriched"
)
def src14_manifest_counts(t):
    rows = corpus.enriched(t("candidates"), t("enrichment"))
    return corpus.corpus_counts(t("candidates"), rows, corpus.selection(rows))


# --- projections ---------------------------------------------------------------------------------------------------------------------


@R.add(
    f"SELECT arxiv_id, {sql_strip(chr(39) * 2 + ' || coalesce(title, ' + chr(39) * 2 + ')')} AS title, {sql_strip('coalesce(abstract, ' + chr(39) * 2 + ')')} AS abstract, categories[1] AS primary_category, nullif({sql_date('published')}, '') AS published, "
    "'https://arxiv.org/abs/' || arxiv_id AS abs_url, 'https://arxiv.org/pdf/' || arxiv_id AS pdf_url, coalesce(len(categories), 0) AS n_categories FROM candidates"
)
def prj01_snapshot_row(t):
    raw = t("candidates").select(
        F.col("arxiv_id").alias("id"), "title", "abstract", "authors", F.array_join("categories", "  ").alias("categories"), F.col("published").alias("update_date"), "license"
    )
    rows = corpus.snapshot_rows(raw)
    return rows.select("arxiv_id", "title", "abstract", "primary_category", "published", "abs_url", "pdf_url", F.size("categories").alias("n_categories"))


BEGIN, END = r"\begin{document}", r"\end{document}"


@R.add(
    f"WITH d AS (SELECT chunk_ord, CASE chunk_ord % 4 WHEN 0 THEN text WHEN 1 THEN 'a {BEGIN}' || text WHEN 2 THEN 'a {BEGIN}' || text || '{END} b' ELSE 'a {BEGIN}' || text || '{END} b {END} c' END AS tex FROM chunks_norm), "
    f"p AS (SELECT *, strpos(tex, '{BEGIN}') AS s, strpos(reverse(tex), reverse('{END}')) AS e FROM d) "
    f"SELECT chunk_ord, md5(CASE WHEN s = 0 THEN tex ELSE substr(tex, s + {len(BEGIN)}, greatest(CASE WHEN e > 0 THEN length(tex) - e - {len(END)} + 2 ELSE length(tex) + 1 END - s - {len(BEGIN)}, 0)) END) AS body FROM p"
)
def prj04_body(t):
    x, k = F.col("text"), F.col("chunk_ord") % 4
    tex = F.when(k == 0, x).when(k == 1, F.concat(F.lit(f"a {BEGIN}"), x)).when(k == 2, F.concat(F.lit(f"a {BEGIN}"), x, F.lit(f"{END} b"))).otherwise(F.concat(F.lit(f"a {BEGIN}"), x, F.lit(f"{END} b {END} c")))
    return t("chunks_norm").select("chunk_ord", tex.alias("tex")).select("chunk_ord", F.md5(text.tex_body(F.col("tex"))).alias("body"))


@R.add("SELECT chunk_ord, " + " OR ".join(f"contains(lower(coalesce(section, '') || ' ' || coalesce(title, '')), '{k}')" for k in text.NOISE_TITLES) + " AS noise FROM chunks_norm")
def prj05_noise(t):
    name = F.concat(F.coalesce("section", F.lit("")), F.lit(" "), F.coalesce("title", F.lit("")))
    return t("chunks_norm").select("chunk_ord", text.noise_section(name).alias("noise"))


@R.add(f"SELECT chunk_ord, md5({sql_scrub('text || ' + _str(STUB_TAIL))}) AS scrubbed FROM chunks_norm")
def prj06_scrub(t):
    return t("chunks_norm").select("chunk_ord", F.md5(text.scrub(F.concat("text", F.lit(STUB_TAIL)))).alias("scrubbed"))


@R.add(f"SELECT count(*) AS total, count(*) FILTER ({sql_scrub('text')} <> text) AS changed FROM chunks_norm")
def prj07_changed(t):
    return t("chunks_norm").agg(F.count("*").alias("total"), F.count_if(text.scrub(F.col("text")) != F.col("text")).alias("changed"))


@R.add(f"SELECT chunk_ord, len({sql_tokens('text')}) AS n, md5(array_to_string({sql_tokens('text')}, ' ')) AS tokens FROM chunks_norm")
def prj08_tokens(t):
    rows = t("chunks_norm").select("chunk_ord", text.tokens(F.col("text")).alias("t"))
    return rows.select("chunk_ord", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@R.add(f"SELECT chunk_ord, round({sql_stop_fraction('text')}, 6) AS stop_fraction FROM chunks_norm")
def prj09_stop_fraction(t):
    return t("chunks_norm").select("chunk_ord", F.round(text.stop_fraction(F.col("text")), 6).alias("stop_fraction"))


@R.add(f"SELECT chunk_ord, {sql_section_type('section')} AS section_type FROM chunks_norm")
def prj10_section_type(t):
    return t("chunks_norm").select("chunk_ord", text.section_type(F.col("section")).alias("section_type"))


CHUNK_OF = "last_chunk AS (SELECT * FROM chunks_norm QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_ord DESC) = 1), asked AS (SELECT DISTINCT question_id, question, source_chunk_id FROM questions)"


def _asked(t, *more):
    """Each question once, with its chunk as delivered last: chunk_ord and the columns named."""
    chunk = corpus.last_by(t("chunks_norm").select("chunk_id", "chunk_ord", *more), ["chunk_id"], [F.col("chunk_ord")])
    asked = t("questions").select("question_id", "question", "source_chunk_id").distinct()
    return asked.join(chunk, asked.source_chunk_id == chunk.chunk_id)


@R.add(
    f"WITH {CHUNK_OF}, k AS (SELECT question_id, list_distinct({sql_tokens('question')}) AS q, {sql_tokens('text')} AS c FROM asked JOIN last_chunk ON source_chunk_id = chunk_id) "
    "SELECT question_id, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, c))::DOUBLE / len(q) ELSE 0.0 END, 3) AS overlap FROM k"
)
def prj11_overlap(t):
    return _asked(t, "text").select("question_id", F.round(text.overlap(F.col("question"), F.col("text")), 3).alias("overlap"))


BM25 = f"""queries AS (SELECT doc_id AS query_id, title AS query FROM documents WHERE doc_id % 100 = 0),
toks AS (SELECT chunk_ord, {sql_tokens("text")} AS t FROM chunks_norm),
lengths AS (SELECT chunk_ord, len(t) AS dl FROM toks),
postings AS (SELECT token, chunk_ord, count(*) AS tf FROM (SELECT chunk_ord, unnest(t) AS token FROM toks) GROUP BY ALL),
basics AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM lengths),
raw AS (SELECT token, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS w FROM (SELECT token, count(*) AS df FROM postings GROUP BY 1), basics),
vocabulary AS (SELECT token, df, CASE WHEN w < 0 THEN {B.epsilon} * (SELECT avg(w) FROM raw) ELSE w END AS idf FROM raw)"""


def bm25_pool(n: int, queries: str | None = None) -> str:
    first = BM25 if queries is None else BM25.replace(BM25[: BM25.index("\ntoks")], queries + ",")
    return f"""{first},
q AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({sql_tokens("query")}) AS token FROM queries) GROUP BY ALL),
scored AS (SELECT query_id, chunk_ord, round(sum(qtf * idf * tf * {B.k1 + 1} / (tf + {B.k1} * (1 - {B.b} + {B.b} * dl / avgdl))), 6) AS score
  FROM q JOIN postings USING (token) JOIN vocabulary USING (token) JOIN lengths USING (chunk_ord), basics GROUP BY ALL),
pool AS (SELECT query_id, chunk_ord, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0.0) DESC, chunk_ord) AS rank
  FROM (SELECT query_id, chunk_ord FROM (SELECT DISTINCT query_id FROM queries), lengths) LEFT JOIN scored USING (query_id, chunk_ord) QUALIFY rank <= {n})"""


SEARCH = f"""{bm25_pool(search.POOL)},
capped AS (SELECT p.*, c.arxiv_id FROM pool p JOIN chunks_norm c USING (chunk_ord) QUALIFY row_number() OVER (PARTITION BY query_id, c.arxiv_id ORDER BY rank) <= {search.PER_PAPER}),
best AS (SELECT query_id, chunk_ord, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM capped QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= {search.TOP}),
found AS (SELECT query_id, rank, round(score, 6) AS score, c.chunk_ord, chunk_id, arxiv_id, title, section, source, abs_url, text FROM best JOIN chunks_norm c USING (chunk_ord))"""


def _queries(t):
    return t("documents").filter(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


def _index(t):
    """The stored index of the chunks; the first search builds it, all others read it."""
    return search.kept_index(t.spark, t.path("chunks_norm"))


def _search(t):
    return search.search(t("chunks_norm"), _queries(t), index=_index(t))


@R.add(
    f"WITH {SEARCH} SELECT query_id, string_agg('[' || (rank - 1) || '] ' || coalesce(title, '') || chr(10) || substr(coalesce(text, ''), 1, {prompts.RANK_CHARS}), chr(10) || chr(10) ORDER BY rank) AS listing FROM found GROUP BY 1"
)
def prj13_prompt_listing(t):
    return prompts.listing(_search(t), prompts.RANK_CHARS)


@R.add(
    f"""SELECT question_id, created_at, 'Draft an abstract-like text of {prompts.EXPANSION_WORDS} words that settles this.' || chr(10) || 'Asked: ' || coalesce(question, '') AS expansion,
    'Pose a question that this excerpt settles, in other words than its own, as {{"question": ..., "answer": ...}}.' || chr(10) || 'From: ' || coalesce(section, '') || chr(10) || 'Excerpt:' || chr(10) || substr(coalesce(question, ''), 1, 20) AS asking FROM questions"""
)
def prj14_prompts(t):
    rows = t("questions")
    return rows.select("question_id", "created_at", prompts.expansion(F.col("question")).alias("expansion"), prompts.asking(F.col("section"), F.col("question"), 20).alias("asking"))


@R.add(f"WITH {SEARCH} SELECT query_id, string_agg(coalesce(nullif(title, ''), arxiv_id) || ' ' || coalesce(nullif(abs_url, ''), arxiv_id), chr(10) ORDER BY rank) AS sources FROM found GROUP BY 1")
def prj15_sources(t):
    return prompts.sources(_search(t))


@R.add("SELECT question_id, sha1('model-a|0.0|256|' || question || '|' || coalesce(arxiv_id, '')) AS key FROM questions")
def prj16_cache_key(t):
    return t("questions").select("question_id", text.cache_key("model-a", "0.0", "256", F.col("question"), F.col("arxiv_id")).alias("key"))


@R.add("SELECT p_partkey, regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9._-]', '_', 'g') AS slug FROM part")
def prj17_slug(t):
    return t("part").select("p_partkey", text.slug(F.concat("p_name", F.lit("/"), "p_brand")).alias("slug"))


@R.add(
    "WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'x' || value WHEN 1 THEN (value / 100)::VARCHAR WHEN 2 THEN (-value)::VARCHAR ELSE 'NaN' END AS s FROM events) "
    "SELECT event_id, round(CASE WHEN s = 'NaN' THEN 0.0 ELSE least(1.0, greatest(0.0, coalesce(try_cast(s AS DOUBLE), 0.0))) END, 6) AS clipped FROM v"
)
def prj18_clip(t):
    k, v = F.col("event_id") % 4, F.col("value")
    s = F.when(k == 0, F.concat(F.lit("x"), v.cast("string"))).when(k == 1, (v / 100).cast("string")).when(k == 2, (-v).cast("string")).otherwise("NaN")
    return t("events").select("event_id", F.round(text.clip01(s), 6).alias("clipped"))


WORDS = (" Yes", "true", "RELEVANT ", "1", "no", "False", "irrelevant", "0", "maybe", "")


@R.add(
    f"WITH v AS (SELECT question_id, created_at, lower({sql_strip('list_extract([' + ', '.join(map(_str, WORDS)) + '], (length(question) % ' + str(len(WORDS)) + ' + 1)::INT)')}) AS w FROM questions) "
    "SELECT question_id, created_at, CASE WHEN w IN ('1', 'true', 'yes', 'relevant') THEN 1 WHEN w IN ('0', 'false', 'no', 'irrelevant') THEN 0 END AS flag, CASE WHEN w IN ('1', 'true', 'yes', 'relevant') THEN 1 WHEN w IN ('0', 'false', 'no', 'irrelevant') THEN 0 END AS flag_in_dict FROM v"
)
def prj19_flag(t):
    """By the string expression, and by the parser of nested verdicts."""
    w = F.element_at(F.array(*map(F.lit, WORDS)), F.length("question") % len(WORDS) + 1)
    nested = F.to_json(F.struct(F.struct(w.alias("label")).alias("verdict")))
    return t("questions").select("question_id", "created_at", text.text_flag(w).alias("flag"), reply.json_flag(nested).alias("flag_in_dict"))


FLAGS = "list_transform(range(0, length(question) % 7), lambda i: ((length(question) + 3 * i) % 4)::INT)"


@R.add(
    f"WITH b AS (SELECT question_id, created_at, list_filter(list_transform({FLAGS}, lambda x: CASE WHEN x < 3 THEN (x % 2)::INT END), lambda x: x IS NOT NULL) AS bits FROM questions) "
    "SELECT question_id, created_at, CASE WHEN len(bits) > 0 THEN bits END AS bits FROM b"
)
def prj20_flags(t):
    """A list of words, numbers, nested verdicts and what is neither, made from the question's length."""
    n = F.length("question")
    each = F.transform(F.when(n % 7 > 0, F.sequence(F.lit(0), n % 7 - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.element_at(F.array(*map(F.lit, ("0", '{"verdict": {"label": " Yes"}}', '"irrelevant"', '"perhaps"'))), (n + 3 * i) % 4 + 1))
    said = F.concat(F.lit('{"note": "x", "relevant": ['), F.array_join(each, ", "), F.lit("]}"))
    return t("questions").select("question_id", "created_at", reply.json_flags(said).alias("bits"))


@R.add("""SELECT question_id, created_at, length(question)::BIGINT AS n, question AS said FROM questions""")
def prj21_json_block(t):
    """An object that holds the question, quoted as JSON, behind prose, a citation, another object and a fence, and before a broken one."""
    held = F.to_json(F.struct(F.col("question").alias("said"), F.struct(F.length("question").alias("n")).alias("a")), {"ignoreNullFields": "false"})
    said = F.concat(F.lit('As in [1], {"old": 1}: ```json\n'), held, F.lit("``` and {} { broken"))
    rows = t("questions").select("question_id", "created_at", reply.json_block(said).alias("v"))
    return rows.select("question_id", "created_at", F.get_json_object("v", "$.a.n").cast("bigint").alias("n"), F.get_json_object("v", "$.said").alias("said"))


# --- filters -------------------------------------------------------------------------------------------------------------------------

MATCH = (
    f"coalesce(list_has_any(categories, [{', '.join(map(_str, C.categories))}]), false) AND NOT ("
    + " OR ".join(f"starts_with(coalesce(categories[1], ''), '{x}')" for x in C.not_led_by)
    + f") AND {sql_year('published')} BETWEEN {C.years[0]} AND {C.years[1]} AND ("
    + " OR ".join(f"contains(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '{k}')" for k in C.naming)
    + ")"
)


@R.add(f"SELECT arxiv_id, title FROM candidates WHERE {MATCH}")
def flt01_paper_match(t):
    return t("candidates").filter(corpus.paper_match(C)).select("arxiv_id", "title")


@R.add(f"WITH {ENRICHED} SELECT arxiv_id, s2_citations FROM enriched WHERE {GATE}")
def flt02_gate(t):
    return corpus.enriched(t("candidates"), t("enrichment")).filter(corpus.gate()).select("arxiv_id", "s2_citations")


BIBLIOGRAPHY = " doi:10.1 doi:10.2 DOI 10.3"


@R.add(f"SELECT chunk_ord, {sql_reference_like('text')} AS dropped, {sql_reference_like('text || ' + _str(BIBLIOGRAPHY))} AS dropped_with_dois FROM chunks_norm")
def flt03_reference_like(t):
    more = F.concat("text", F.lit(BIBLIOGRAPHY))
    return t("chunks_norm").select("chunk_ord", text.reference_like(F.col("text")).alias("dropped"), text.reference_like(more).alias("dropped_with_dois"))


@R.add(
    "WITH d AS (SELECT DISTINCT question_id, question_set, question FROM questions), "
    "c AS (SELECT *, CASE WHEN trim(question) = '' OR question IS NULL THEN 'blank' WHEN length(question) > 40 THEN 'too_long' ELSE 'ok' END AS s FROM d), "
    "u AS (SELECT *, count(*) FILTER (s = 'ok') OVER (PARTITION BY question_set ORDER BY question_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM c) "
    "SELECT question_id, CASE WHEN s <> 'ok' THEN s WHEN used >= 20 THEN 'limit' ELSE 'ok' END AS status FROM u"
)
def flt06_guards(t):
    """A question set stands for a session, in order of question_id; 40 characters are allowed, so that every case occurs."""
    rows = t("questions").select("question_id", "question_set", "question").distinct()
    before = W.partitionBy("question_set").orderBy("question_id").rowsBetween(W.unboundedPreceding, -1)
    fits = F.when(prompts.guard(F.col("question"), F.lit(0), 40) == "ok", 1)
    return rows.select("question_id", prompts.guard(F.col("question"), F.count(fits).over(before), 40).alias("status"))


# --- sections and chunks -------------------------------------------------------------------------------------------------------------

MARKED = (r"head \section{Introduction} ", r" \subsection*{Data set} \section{References} [1] x")
BODY = f"'{MARKED[0]}' || coalesce(text, '') || '{MARKED[1]}'"
SPANS = f"""b AS (SELECT doc_id, {BODY} AS body FROM documents),
s AS (SELECT doc_id, unnest(list_zip(list_prepend('', regexp_extract_all(body, '{chunking.SECTION_MARK}', 1)), regexp_split_to_array(body, '{chunking.SECTION_MARK}'), range(0, 1 + len(regexp_extract_all(body, '{chunking.SECTION_MARK}'))))) AS z FROM b),
f AS (SELECT doc_id, z[1] AS section, {sql_strip("coalesce(z[2], '')")} AS text, z[3] AS i FROM s),
sections AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS section_index, section, text FROM f WHERE text <> '' AND NOT ({" OR ".join(f"contains(lower(section), '{k}')" for k in text.NOISE_TITLES)}))"""


def _bodies(t):
    return t("documents").select("doc_id", F.concat(F.lit(MARKED[0]), F.coalesce("text", F.lit("")), F.lit(MARKED[1])).alias("body"))


@R.add(f"WITH {SPANS} SELECT doc_id, section_index, section, md5(text) AS text FROM sections")
def exp01_sections(t):
    return chunking.sections(_bodies(t), "doc_id", "body").withColumn("text", F.md5("text"))


def sql_chunks(rows: str) -> str:
    return f"""w AS (SELECT *, {sql_words("text")} AS ws FROM {rows}),
o AS (SELECT *, unnest(range(0, len(ws), {chunking.SIZE - chunking.SHARED})) AS st FROM w),
chunks AS (SELECT doc_id, section, section_index, (row_number() OVER (PARTITION BY doc_id, section_index ORDER BY st) - 1)::INT AS chunk_index,
  array_to_string(ws[st + 1:st + {chunking.SIZE}], ' ') AS text, least({chunking.SIZE}, len(ws) - st)::INT AS n_words FROM o WHERE st = 0 OR len(ws) - st >= {chunking.FEWEST})"""


@R.add(
    f"WITH plain AS (SELECT doc_id, 'body' AS section, 0 AS section_index, text FROM documents), {sql_chunks('plain')} SELECT doc_id || ':' || section_index || ':' || chunk_index AS chunk_id, n_words, md5(text) AS text FROM chunks"
)
def exp02_chunks(t):
    rows = t("documents").select("doc_id", F.lit("body").alias("section"), F.lit(0).alias("section_index"), "text")
    return chunking.chunks(rows, "doc_id").select("chunk_id", "n_words", F.md5("text").alias("text"))


PAGE = "'<script>var a = 1;</script><h1>A &amp; B</h1><p class=\"x\">' || text || '</p><!-- c --><ul><li>one</li><li>two&nbsp;&lt; 3</li></ul>'"


def sql_page(x: str) -> str:
    for pattern, to in text.PAGE_STEPS:
        x = f"regexp_replace({x}, {_str(pattern)}, {_str(to) if to != chr(10) else 'chr(10)'}, 'g')"
    return sql_strip(x)


@R.add(f"SELECT doc_id, md5({sql_page(PAGE)}) AS text FROM documents")
def exp03_page_text(t):
    page = F.concat(F.lit('<script>var a = 1;</script><h1>A &amp; B</h1><p class="x">'), "text", F.lit("</p><!-- c --><ul><li>one</li><li>two&nbsp;&lt; 3</li></ul>"))
    return t("documents").select("doc_id", F.md5(text.page_text(page)).alias("text"))


# --- joins and aggregates ------------------------------------------------------------------------------------------------------------


@R.add(f"WITH {LATEST} SELECT arxiv_id, s2_citations, cached_at FROM latest")
def jon01_cache_merge(t):
    return corpus.last_by(t("enrichment"), ["arxiv_id"], [F.col("cached_at")]).select("arxiv_id", "s2_citations", "cached_at")


@R.add("SELECT arxiv_id, title FROM candidates ANTI JOIN enrichment USING (arxiv_id)")
def jon02_pending(t):
    return corpus.pending(t("candidates"), t("enrichment"), "arxiv_id").select("arxiv_id", "title")


@R.add(
    f"WITH c AS (SELECT unnest([{', '.join(map(_str, metrics.CONFIGS))}]) AS config), r AS (SELECT DISTINCT question_id, config FROM tier1_results) "
    "SELECT q.question_id, c.config, r.config IS NOT NULL AS scored FROM (SELECT DISTINCT question_id FROM questions) q, c LEFT JOIN r ON r.question_id = q.question_id AND r.config = c.config"
)
def jon10_question_configs(t):
    """Every question with every configuration: the second side has four rows."""
    asked = t("questions").select("question_id").distinct().withColumn("config", F.explode(F.array(*map(F.lit, metrics.CONFIGS))))
    done = t("tier1_results").select("question_id", "config").distinct().withColumn("scored", F.lit(True))
    return asked.join(done, ["question_id", "config"], "left").withColumn("scored", F.coalesce("scored", F.lit(False)))


@R.add(f"WITH {BM25} SELECT token, count(*) AS df, sum(tf)::BIGINT AS tf FROM postings GROUP BY 1")
def agg01_postings(t):
    return bm25.build(t("chunks_norm")).postings.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@R.add(f"WITH {BM25} SELECT token, df, round(idf, 9) AS idf FROM vocabulary")
def agg02_idf(t):
    return bm25.build(t("chunks_norm")).vocabulary.select("token", "df", F.round("idf", 9).alias("idf"))


@R.add(
    "WITH l AS (SELECT arxiv_id, arg_max(coalesce(lower(trim(source)), '~'), chunk_ord) FILTER (source IS NOT NULL) AS s, count(*) AS n FROM chunks_norm GROUP BY 1) "
    "SELECT count(*) AS papers, sum(n)::BIGINT AS chunks, count(*) FILTER (s = 'latex') AS latex, count(*) FILTER (s = 'pdf') AS pdf FROM l"
)
def agg04_chunk_stats(t):
    rows = t("chunks_norm")
    return metrics.chunk_stats(rows)


@R.add("SELECT lower(trim(source)) AS kind, count(*) AS n FROM chunks_norm GROUP BY 1")
def agg05_kinds(t):
    return t("chunks_norm").groupBy(F.lower(F.trim("source")).alias("kind")).agg(F.count("*").alias("n"))


# --- ranked retrieval ----------------------------------------------------------------------------------------------------------------


@R.add(f"WITH {bm25_pool(search.TOP)} SELECT query_id, chunk_ord, score, rank::INT AS rank FROM pool")
def top02_bm25_topk(t):
    return search.pool(t("chunks_norm"), _queries(t), search.TOP, index=_index(t)).select("query_id", "chunk_ord", "score", "rank")


@R.add(f"WITH {SEARCH} SELECT query_id, rank::INT AS rank, score, chunk_ord, chunk_id, arxiv_id, title, section, source, abs_url, text FROM found")
def top03_search_diverse(t):
    return _search(t)


@R.add(
    f"WITH {ENRICHED} SELECT arxiv_id, s2_citations, row_number() OVER (ORDER BY s2_citations DESC, coalesce(published, '') DESC, arxiv_id)::INT AS sel_rank FROM enriched WHERE {GATE} QUALIFY sel_rank <= {corpus.PAPERS}"
)
def top04_selection(t):
    return corpus.selection(corpus.enriched(t("candidates"), t("enrichment"))).select("arxiv_id", "s2_citations", "sel_rank")


@R.add(
    "WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) "
    "SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p QUALIFY rank <= 10"
)
def top05_dense_topk(t):
    v = t("embeddings")
    return dense.top_dense(v, v.filter(F.col("vec_id") % 100 == 0), search.TOP)


@R.add(
    f"WITH {bm25_pool(search.TOP)}, l AS (SELECT query_id, chunk_ord, rank - 1 AS local_idx FROM pool), "
    "m AS (SELECT *, CASE WHEN local_idx % 2 = 0 THEN 100 - local_idx END AS pos FROM l) "
    "SELECT query_id, chunk_ord, CASE WHEN pos IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY pos NULLS LAST, local_idx)::INT AS rank FROM m"
)
def top06_rerank_fill(t):
    """A model's order of the even places, from the back, with a repeat and a place outside the pool; the rest follows."""
    rows = search.pool(t("chunks_norm"), _queries(t), search.TOP, index=_index(t)).withColumn("local_idx", F.col("rank") - 1).drop("rank", "score")
    even = rows.filter(F.col("local_idx") % 2 == 0).select("query_id", "local_idx", (100 - F.col("local_idx")).alias("model_pos"), F.lit(0.5).alias("rerank_score"))
    odd = even.select("query_id", "local_idx", (F.col("model_pos") + 500).alias("model_pos"), F.lit(0.1).alias("rerank_score"))
    out = even.select("query_id", F.lit(999).alias("local_idx"), F.lit(0).alias("model_pos"), F.lit(0.9).alias("rerank_score"))
    return ranking.rerank_fill(rows, even.unionByName(odd).unionByName(out)).select("query_id", "chunk_ord", "rerank_score", "rank")


@R.add(
    f"WITH r AS (SELECT chunk_ord, arxiv_id, {sql_section_type('section')} AS section_type, md5('{sampling.SEED}:' || chunk_ord) AS h FROM chunks_norm), "
    f"c AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY h, chunk_ord) <= {sampling.PER_PAPER}), "
    'p AS (SELECT *, row_number() OVER (PARTITION BY section_type ORDER BY h, chunk_ord)::INT AS "pass" FROM c) '
    f'SELECT chunk_ord, arxiv_id, section_type, "pass" FROM p ORDER BY "pass", section_type LIMIT {sampling.QUESTIONS}'
)
def win03_stratified_sample(t):
    return sampling.stratified(t("chunks_norm"))


# --- evaluation ----------------------------------------------------------------------------------------------------------------------

GOLD = rf"""{CHUNK_OF},
gold AS (SELECT a.question_id, any_value(a.question) AS question, any_value(a.source_chunk_id) AS source_chunk_id, any_value(c.arxiv_id) AS gold_paper, any_value(c.chunk_ord) AS gold_ord FROM asked a JOIN last_chunk c ON a.source_chunk_id = c.chunk_id WHERE c.chunk_ord % 100 = 0 GROUP BY 1)"""
#: All questions of the table.
ASKED = GOLD.replace(" WHERE c.chunk_ord % 100 = 0", "")
HITS = f"""{GOLD}, {bm25_pool(metrics.K, "queries AS (SELECT question_id AS query_id, question AS query FROM gold)")},
best AS (SELECT query_id, min(CASE WHEN c.chunk_id = g.source_chunk_id THEN rank END) AS c, min(CASE WHEN c.arxiv_id = g.gold_paper THEN rank END) AS p FROM pool JOIN chunks_norm c USING (chunk_ord) JOIN gold g ON g.question_id = query_id GROUP BY 1)"""


def _gold(t, every: int = 100):
    """Questions with their chunk's paper; of those, the ones whose chunk has an id divisible by `every`."""
    rows = _asked(t).filter(F.col("chunk_ord") % every == 0).join(t("chunks_norm").select("chunk_ord", F.col("arxiv_id").alias("gold_paper")), "chunk_ord")
    return rows.select("question_id", "question", "source_chunk_id", "gold_paper")


@R.add(
    f"WITH {HITS} SELECT query_id AS question_id, (c IS NOT NULL)::DOUBLE AS recall_chunk, (p IS NOT NULL)::DOUBLE AS recall_paper, round(coalesce(1.0 / c, 0.0), 6) AS mrr_chunk, round(coalesce(1.0 / p, 0.0), 6) AS mrr_paper FROM best"
)
def agg08_agg09_question_scores(t):
    """BM25 on the questions whose source chunk has an id divisible by 100, against all chunks."""
    gold = _gold(t)
    asked = gold.select(F.col("question_id").alias("query_id"), F.col("question").alias("query"))
    got = search.pool(t("chunks_norm"), asked, metrics.K, index=_index(t)).withColumnRenamed("query_id", "question_id").join(t("chunks_norm").select("chunk_ord", "chunk_id", "arxiv_id"), "chunk_ord")
    s = metrics.question_scores(got, gold, metrics.K)
    return s.withColumns({m: F.round(m, 6) for m in ("mrr_chunk", "mrr_paper")})


@R.add(
    "WITH d AS (SELECT DISTINCT * FROM tier1_results), m AS (SELECT config, avg(recall_chunk) AS recall_chunk, avg(recall_paper) AS recall_paper, avg(mrr_chunk) AS mrr_chunk, avg(mrr_paper) AS mrr_paper FROM d GROUP BY 1) "
    "SELECT config, metric, round(value, 4) AS value FROM m UNPIVOT (value FOR metric IN (recall_chunk, recall_paper, mrr_chunk, mrr_paper))"
)
def agg10_means(t):
    return metrics.config_means(t("tier1_results"))


@R.add(
    "SELECT "
    + ", ".join(f"round(coalesce(avg({m}), 0.0), 4) AS {m}_mean, count({m}) AS {m}_scored, count(*) FILTER ({m} IS NULL) AS {m}_failed" for m in ("faithfulness", "answer_relevance", "context_precision"))
    + " FROM tier2_results"
)
def agg11_judged_means(t):
    return metrics.judged_means(t("tier2_results"))


@R.add(
    "WITH b AS (SELECT question_id, created_at, list_transform(range(0, length(question) % 5), lambda i: (i + length(question)) % 2) AS bits FROM questions) "
    "SELECT question_id, created_at, CASE WHEN len(bits) > 0 THEN round(list_sum(bits)::DOUBLE / len(bits), 6) END AS context_precision FROM b"
)
def agg12_precision(t):
    n = F.length("question") % 5
    bits = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i + F.length("question")) % 2)).otherwise(F.array().cast("array<int>"))
    return t("questions").select("question_id", "created_at", bits.alias("b")).select("question_id", "created_at", F.round(metrics.precision(F.col("b")), 6).alias("context_precision"))


BANDS = f"""o AS (SELECT question_id, max(CASE WHEN overlap < {metrics.LOW} THEN 'low' WHEN overlap < {metrics.HIGH} THEN 'mid' WHEN overlap IS NOT NULL THEN 'high' END) AS band FROM questions GROUP BY 1)"""


@R.add(
    f"WITH {BANDS}, d AS (SELECT DISTINCT * FROM tier1_results) SELECT config, band, count(*) AS n, round(avg(recall_chunk), 4) AS recall_chunk, round(avg(recall_paper), 4) AS recall_paper FROM d JOIN o USING (question_id) GROUP BY 1, 2"
)
def agg13_overlap_bands(t):
    bands = t("questions").groupBy("question_id").agg(F.max(metrics.band(F.col("overlap"))).alias("band"))
    rows = t("tier1_results").distinct().join(bands, "question_id")
    return rows.groupBy("config", "band").agg(F.count("*").alias("n"), F.round(F.avg("recall_chunk"), 4).alias("recall_chunk"), F.round(F.avg("recall_paper"), 4).alias("recall_paper"))


@R.add(
    "WITH n AS (SELECT arxiv_id, coalesce(section, '') AS section, count(*) AS n FROM chunks_norm GROUP BY 1, 2) SELECT arxiv_id, section, n FROM n QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY n DESC, section) = 1"
)
def agg14_argmax_section(t):
    """The section with most chunks of each paper, by max_by with a tie rule, as the main file of an archive is chosen."""
    n = t("chunks_norm").groupBy("arxiv_id", F.coalesce("section", F.lit("")).alias("section")).agg(F.count("*").alias("n"))
    best = n.groupBy("arxiv_id").agg(F.max("n").alias("n"))
    return n.join(best, ["arxiv_id", "n"]).groupBy("arxiv_id").agg(F.min("section").alias("section"), F.first("n").alias("n"))


@R.add(
    "WITH m AS (SELECT config, count(*) AS n, avg(recall_chunk) AS p FROM (SELECT DISTINCT * FROM tier1_results) GROUP BY 1) SELECT config, n, round(1.96 * sqrt(p * (1 - p) / n), 6) AS half_width FROM m"
)
def agg15_half_width(t):
    m = t("tier1_results").distinct().groupBy("config").agg(F.count("*").alias("n"), F.avg("recall_chunk").alias("p"))
    return m.select("config", "n", metrics.half_width(F.col("p"), F.col("n")).alias("half_width"))


# --- cache, models, incremental ------------------------------------------------------------------------------------------------------


@R.add(
    "WITH r AS (SELECT DISTINCT question_id, sha1('judge|' || question_id) AS key FROM questions), c AS (SELECT sha1('judge|' || question_id) AS key, max(answer_relevance::VARCHAR) AS value FROM tier2_results WHERE answer_relevance IS NOT NULL AND answer_relevance <> 0 GROUP BY 1) "
    "SELECT question_id, c.key IS NOT NULL AS hit FROM r LEFT JOIN c USING (key)"
)
def inc01_cache_miss(t):
    asked = t("questions").select("question_id").distinct().withColumn("key", text.cache_key("judge", F.col("question_id")))
    store = cache.storable(t("tier2_results").select(text.cache_key("judge", F.col("question_id")).alias("key"), F.col("answer_relevance").cast("string").alias("value")))
    return cache.hits(asked, store).select("question_id", F.col("value").isNotNull().alias("hit"))


@R.add(
    f"WITH {SPANS}, {sql_chunks('sections')} SELECT doc_id || ':' || section_index || ':' || chunk_index AS chunk_id, md5({sql_scrub('text')}) AS text, n_words FROM chunks WHERE NOT {sql_reference_like('text')}"
)
def inc02_incremental_chunks(t):
    """The batch form of the stream's plan; a test compares both."""
    return ingest.chunk_stream(_bodies(t), "doc_id").select("chunk_id", F.md5("text").alias("text"), "n_words")


@R.add(
    f"WITH {SPANS}, {sql_chunks('sections')} SELECT doc_id || ':' || section_index || ':' || chunk_index AS chunk_id, md5({sql_scrub('text')}) AS text, n_words FROM chunks WHERE NOT {sql_reference_like('text')}"
)
def inc02_streamed_chunks(t):
    """The same as a stream that takes what files are new, once, into a sink of the shared folder."""
    at = f"{files.shared_folder(t.spark)}/ingest-{files.fingerprint(t.spark, t.path('documents'))}"
    source = t("documents")
    bodies = lambda rows: _bodies(lambda name: rows)
    ingest.ingest(t.spark, f"{t.folder}/documents*.parquet", source.schema, f"{at}/chunks", f"{at}/mark", "doc_id", "body", bodies).awaitTermination()
    return t.spark.read.parquet(f"{at}/chunks").select("chunk_id", F.md5("text").alias("text"), "n_words")


@R.add(
    "WITH r AS (SELECT DISTINCT question_id, sha1('judge|' || question_id) AS key FROM questions), c AS (SELECT sha1('judge|' || question_id) AS key, max(answer_relevance::VARCHAR) AS value FROM tier2_results WHERE answer_relevance IS NOT NULL AND answer_relevance <> 0 GROUP BY 1) "
    "SELECT question_id, coalesce(c.value, chr(34) || md5(key) || chr(34)) AS value FROM r LEFT JOIN c USING (key)"
)
def inc01_read_through(t):
    """A cache table that holds the delivered verdicts; what it lacks is worked out, added and read back."""
    at = f"{files.shared_folder(t.spark)}/cache-{files.fingerprint(t.spark, t.path('tier2_results'), files.fingerprint(t.spark, t.path('questions')))}"
    delivered = lambda: cache.storable(t("tier2_results").select(text.cache_key("judge", F.col("question_id")).alias("key"), F.col("answer_relevance").cast("string").alias("value")))
    if not files.exists(t.spark, at):
        delivered().write.parquet(at)
    asked = t("questions").select("question_id").distinct().withColumn("key", text.cache_key("judge", F.col("question_id")))
    made = lambda rows: rows.select("key", F.concat(F.lit('"'), F.md5("key"), F.lit('"')).alias("value"))
    return cache.read_through(asked, at, made).select("question_id", "value")


# --- model-backed steps, with the stand-ins ------------------------------------------------------------------------------------------

EXPANDED = "coalesce(question || ' ', '') || array_to_string(list_slice(regexp_extract_all(coalesce(question, ''), '[A-Za-z]{3,}'), 1, 3), ' ')"
#: The stand-in's order of a pool: every other place from the last one back, then the others.
RANKED = """ranked AS (SELECT query_id, chunk_ord, rank - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM pool),
reranked AS (SELECT query_id, chunk_ord, CASE WHEN (n - 1 - i) % 2 = 0 THEN round((i + 1)::DOUBLE / n, 6) ELSE 0.0 END AS rerank_score,
  row_number() OVER (PARTITION BY query_id ORDER BY (n - 1 - i) % 2, CASE WHEN (n - 1 - i) % 2 = 0 THEN -i ELSE i END)::INT AS rank FROM ranked)"""
HYDE_POOL = f"""{bm25_pool(models.CANDIDATES, f"queries AS (SELECT question_id AS query_id, {EXPANDED} AS query FROM gold)")}, {RANKED}"""
CONTEXT = f"{HYDE_POOL}, context AS (SELECT query_id AS question_id, rank, rerank_score, c.* FROM reranked JOIN chunks_norm c USING (chunk_ord) WHERE rank <= {search.TOP})"
ANSWERS = f"""{ASKED}, {CONTEXT}, answers AS (SELECT question_id, question, {sql_strip(f"CASE WHEN coalesce(title, '') <> '' THEN title || ' [0]' ELSE {_str(models.REFUSAL)} END")} AS answer
  FROM gold JOIN context USING (question_id) WHERE rank = 1)"""
VERDICTS = """round(least(1.0, (length(answer) % 13) / 10.0), 6)::DOUBLE AS faithfulness,
  CASE WHEN length(coalesce(question, '')) % 5 <> 0 THEN round(least(1.0, (length(coalesce(question, '')) % 11) / 10.0), 6)::DOUBLE END AS answer_relevance,
  CASE WHEN length(coalesce(question, '')) % 5 <> 0 THEN round(2 / 3, 6)::DOUBLE END AS context_precision"""


@R.add(f"SELECT DISTINCT question_id, {EXPANDED} AS query FROM questions")
def llm01_expanded(t):
    return models.expanded(t("questions").select("question_id", "question").distinct(), models.ExpandStub())


@R.add(f"WITH {GOLD}, {CONTEXT} SELECT question_id, rank, rerank_score, chunk_ord, chunk_id, arxiv_id, title, section, source, abs_url, text FROM context")
def llm02_llm03_llm04_reranked(t):
    """Full chunk rows with the model's score, and so the context of an answer: ranked anew from the pool of the expanded question."""
    return models.rerank(_gold(t), t("chunks_norm"), models.STUBS, index=_index(t)).select("question_id", "rank", F.round("rerank_score", 6).alias("rerank_score"), "chunk_ord", *search.RESULT)


@R.add(f"WITH {ANSWERS} SELECT question_id, question, answer FROM answers")
def llm05_answers(t):
    """The answer to each question of the table from its own context."""
    return models.answers(_gold(t, 1), t("chunks_norm"), models.STUBS, index=_index(t))


@R.add(
    f"""WITH w AS (SELECT *, regexp_extract_all(substr(coalesce(text, ''), 1, {prompts.READ_CHARS}), '[A-Za-z]{{3,}}') AS w FROM chunks_norm WHERE chunk_ord % 100 = 0),
    q AS (SELECT *, 'What is ' || w[1] || '?' AS question FROM w WHERE len(w) > 1), k AS (SELECT *, list_distinct({sql_tokens("question")}) AS q, {sql_tokens("text")} AS c FROM q)
    SELECT chunk_id AS question_id, question, w[2] AS reference_answer, chunk_id AS source_chunk_id, arxiv_id, section, {sql_section_type("section")} AS section_type,
    round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, c))::DOUBLE / len(q) ELSE 0.0 END, 3) AS overlap FROM k"""
)
def llm06_questions(t):
    return models.generated(t("chunks_norm").filter("chunk_ord % 100 = 0"), models.AskStub())


@R.add(f"WITH {ANSWERS} SELECT question_id, {VERDICTS} FROM answers")
def llm07_llm09_cells(t):
    """Context, answer and three verdicts for each question of the table."""
    out = models.cell(_gold(t, 1), t("chunks_norm"), models.STUBS, index=_index(t))
    return out.select("question_id", *[F.round(m, 6).alias(m) for m in ("faithfulness", "answer_relevance", "context_precision")])


@R.add("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS length FROM embeddings")
def llm08_unit_vectors(t):
    v = t("embeddings").select("vec_id", dense.normalized(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 4).alias("length"))


def sql_scores(arms: list[str]) -> str:
    """Retrieval metrics of rows (question_id, config, rank, chunk_ord)."""
    rows = " UNION ALL ".join(arms)
    return f"""found AS ({rows}), best AS (SELECT question_id, config, min(CASE WHEN c.chunk_id = g.source_chunk_id THEN rank END) AS c, min(CASE WHEN c.arxiv_id = g.gold_paper THEN rank END) AS p
  FROM found JOIN chunks_norm c USING (chunk_ord) JOIN gold g USING (question_id) WHERE rank <= {metrics.K} GROUP BY ALL)
SELECT question_id, config, (c IS NOT NULL)::DOUBLE AS recall_chunk, (p IS NOT NULL)::DOUBLE AS recall_paper, round(coalesce(1.0 / c, 0.0), 6) AS mrr_chunk, round(coalesce(1.0 / p, 0.0), 6) AS mrr_paper FROM best"""


BOTH = f"queries AS (SELECT 'p|' || question_id AS query_id, question AS query FROM gold UNION ALL SELECT 'h|' || question_id AS query_id, {EXPANDED} AS query FROM gold)"


def _arm(config: str, rows: str, kind: str) -> str:
    return f"SELECT substr(query_id, 3) AS question_id, '{config}' AS config, rank, chunk_ord FROM {rows} WHERE starts_with(query_id, '{kind}|')"


@R.add(f"WITH {GOLD}, {bm25_pool(models.CANDIDATES, BOTH)}, {RANKED}, {sql_scores([_arm('bm25', 'pool', 'p'), _arm('hyde', 'pool', 'h'), _arm('rerank', 'reranked', 'h'), _arm('rerank_nohyde', 'reranked', 'p')])}")
def eval_arms(t):
    """Four pipelines on the questions whose source chunk has an id divisible by 100, against all chunks."""
    s = models.arm_scores(metrics.CONFIGS, _gold(t), t("chunks_norm"), models.STUBS, metrics.K, index=_index(t))
    return s.withColumns({m: F.round(m, 6) for m in ("mrr_chunk", "mrr_paper")})


@R.add(
    f"""WITH {GOLD}, v AS (SELECT chunk_ord, embedding::DOUBLE[] AS e FROM embeddings JOIN chunks_norm ON vec_id = chunk_ord),
scored AS (SELECT question_id AS query_id, v.chunk_ord, round(list_inner_product(q.e, v.e), 6) AS score FROM gold JOIN v q ON q.chunk_ord = gold_ord // 100, v),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_ord) AS rank FROM scored QUALIFY rank <= {models.CANDIDATES}), {RANKED},
{sql_scores(["SELECT query_id AS question_id, 'dense' AS config, rank, chunk_ord FROM pool", "SELECT query_id AS question_id, 'dense_rerank' AS config, rank, chunk_ord FROM reranked"])}"""
)
def eval_dense_arms(t):
    """The two pipelines over vectors: a question has the vector numbered by a hundredth of its source chunk's id."""
    chunks = t("chunks_norm")
    vectors = t("embeddings").select(F.col("vec_id").alias("chunk_ord"), "embedding").join(chunks.select("chunk_ord"), "chunk_ord", "left_semi")
    gold = _gold(t).join(chunks.filter("chunk_ord % 100 = 0").select(F.col("chunk_id").alias("source_chunk_id"), F.expr("chunk_ord div 100").alias("chunk_ord")), "source_chunk_id").join(vectors, "chunk_ord").drop("chunk_ord")
    s = models.arm_scores(("dense", "dense_rerank"), gold, chunks, models.STUBS, metrics.K, vectors=vectors)
    return s.withColumns({m: F.round(m, 6) for m in ("mrr_chunk", "mrr_paper")})
