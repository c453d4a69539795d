"""Model-backed steps behind an interface: expansion, ranking, answers, judgments, questions, and the evaluation of whole pipelines.

A client completes a prompt. Replies go through a cache table whose key holds everything a reply depends on, so a run repeats no call of an earlier
one. Every reply is written before it is used: a plan that reads replies twice calls the model once. The stand-ins are deterministic, so that
pipelines run and can be checked without a model; their quality says nothing about a model's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.functions.reply import flags_of, last_json, scored_ranking
from chalkline.functions.text import cache_key, overlap, section_type, strip
from chalkline.operators import dense, metrics, prompts, ranking
from chalkline.plans import search
from chalkline.sources import cache, files

#: Fixed value: what an answer says where the passages do not hold one.
REFUSAL = "the provided context does not answer this question."
#: Fixed value: candidates that a model ranks.
CANDIDATES = 50
EXPAND = "You draft texts for a search index of earth science. Use the field's own terms and their common variants, in plain statements. The text is matched and never shown."
RANK = "You sort excerpts for a search over earth-science papers by how well each one settles what is asked. Reply with the JSON list alone."
ANSWER = f"You reply from numbered excerpts and nothing else, naming each one used by its number in brackets. Where they do not hold the reply, write only: {REFUSAL}"
ASK = "You write test questions for a search over earth-science papers. Reply with one JSON object."
SUPPORT = 'Rate from 0 to 1 how much of what the reply states is borne out by the excerpts; a reply that declines states nothing and gets 1. Form: {"score": 0.5}.'
FIT = 'Rate from 0 to 1 how far the reply takes up what is asked, true or not. Form: {"score": 0.5}.'
USE = 'Mark each excerpt, in order, with 1 if it helps to settle what is asked and 0 if not. Form: {"relevant": [1, 0]}.'


class ModelClient(Protocol):
    name: str

    def complete(self, system: str, prompt: str) -> str: ...


# --- stand-ins -----------------------------------------------------------------------------------------------------------------------


def _words(text: str) -> list[str]:
    return re.findall("[A-Za-z]{3,}", text)


class ExpandStub:
    """The first three long words of what is asked."""

    name = "stub-expand"

    def complete(self, system: str, prompt: str) -> str:
        return " ".join(_words(prompt.partition("\nAsked: ")[2])[:3])


class RankStub:
    """Every other excerpt, from the last one back, with prose around it, a number twice and one that does not exist."""

    name = "stub-rank"

    def complete(self, system: str, prompt: str) -> str:
        n = int(re.match(r"Order (\d+) ", prompt)[1])
        rows = [{"index": i, "score": round((i + 1) / n, 6)} for i in range(n - 1, -1, -2)]
        return f"As in [1]: {json.dumps([*rows, *rows[:1], {'index': n, 'score': 1.0}])}."


class AnswerStub:
    """The first excerpt's title with its number, or the refusal if it has none."""

    name = "stub-answer"

    def complete(self, system: str, prompt: str) -> str:
        m = re.match(r"Excerpts:\n\[0\] ([^\n]+)\n", prompt)
        return f"{m[1]} [0]" if m else REFUSAL


class JudgeStub:
    """Scores by lengths: of the reply, of what is asked; marks every third excerpt; every fifth text gets an unreadable verdict."""

    name = "stub-judge"

    def complete(self, system: str, prompt: str) -> str:
        if system == USE:
            asked = prompt[len("Asked: ") :].partition("\n\nExcerpts:\n")[0]
            return json.dumps({"relevant": [1, "no", {"label": "yes"}, "perhaps"]}) if len(asked) % 5 else "no idea"
        reply = prompt.rpartition("\n\nReply to check:\n")[2]
        if system == SUPPORT:
            return f'Well, {{"score": "{len(reply) % 13 / 10}"}}'
        asked = prompt[len("Asked: ") :].rpartition("\n\nReply to check:\n")[0]
        return json.dumps({"score": len(asked) % 11 / 10}) if len(asked) % 5 else '{"score": '


class AskStub:
    """A question of the excerpt's first long word with its second one as the answer."""

    name = "stub-ask"

    def complete(self, system: str, prompt: str) -> str:
        w = _words(prompt.partition("\nExcerpt:\n")[2])
        return f'Here: {{"question": " What is {w[0] if w else ""}? ", "answer": "{w[1] if len(w) > 1 else " "}"}}'


# --- calls ---------------------------------------------------------------------------------------------------------------------------


def completed(asked: DataFrame, client: ModelClient, system: str) -> DataFrame:
    """key, value (reply as JSON string) for each row with key and prompt; one call per distinct key, in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "value": [json.dumps(client.complete(system, p)) for p in b["prompt"]]})

    return asked.select("key", "prompt").dropDuplicates(["key"]).mapInPandas(run, "key string, value string")


def ask(asked: DataFrame, client: ModelClient, system: str, path: str | None = None, **settings) -> DataFrame:
    """Rows with prompt, plus `reply`; an older reply column is replaced, a null prompt has a null reply. With a path, replies come from the cache
    table there and new ones are added; without one they are written to the shared folder for this run alone. An empty reply is not cached."""
    spark = asked.sparkSession
    rows = asked.drop("reply").withColumn("key", F.when(F.col("prompt").isNotNull(), cache_key(client.name, json.dumps(settings, sort_keys=True), system, F.col("prompt"))))
    calls = rows.filter(F.col("key").isNotNull()).select("key", "prompt").distinct()
    if path is None:
        files.shared_folder(spark)
        known = completed(calls, client, system).checkpoint()
    else:
        known = cache.read_through(calls, path, lambda new: completed(new, client, system)).select("key", "value")
    replies = known.select("key", F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v").alias("reply"))
    return rows.join(replies, "key", "left").drop("key", "prompt")


def replied(rows: DataFrame, prompt: Column, client: ModelClient, system: str, name: str = "reply") -> DataFrame:
    """Rows and the reply to each one's prompt, made where the prompt is; the prompt goes no further. For prompts that are known to be distinct,
    in a plan that is read once."""

    @F.pandas_udf(T.StringType())
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else client.complete(system, p) for p in prompts], dtype=object)

    return rows.withColumn(name, run.asNondeterministic()(prompt))


def once(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(question_id, question and the text's own id `_same`; each text once, with that id as question_id). What is asked alike is searched,
    ranked, answered and judged alike."""
    files.shared_folder(questions.sparkSession)
    asked = questions.select("question_id", "question").withColumn("_same", F.coalesce("question", F.lit(""))).checkpoint()  # read by every step
    return asked, asked.select(F.col("_same").alias("question_id"), F.col("_same").alias("question")).distinct()


def spread(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of each text to all questions that have it."""
    return rows.withColumnRenamed("question_id", "_same").join(asked.select("question_id", "_same"), "_same").drop("_same")


def expanded(questions: DataFrame, client: ModelClient, echo: bool = True, path: str | None = None, words: int = prompts.EXPANSION_WORDS) -> DataFrame:
    """question_id and `query`: the model's text, after the question if echo."""
    out = ask(questions.select("question_id", "question", prompts.expansion(F.col("question"), words).alias("prompt")), client, EXPAND, path, words=words)
    return out.select("question_id", (F.concat_ws(" ", "question", "reply") if echo else F.col("reply")).alias("query"))


def reranked(pool: DataFrame, questions: DataFrame, client: ModelClient, top: int | None = None, path: str | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """The pool in the model's order with `rerank_score` and a new rank. pool: question_id, rank, title, text and more; with chunks, title and text
    come from there by chunk_ord, and the questions' texts are distinct. What the model left out follows in the pool's order with 0.0; a repeated
    number counts once, a number outside the pool and an unreadable reply count as nothing."""
    listed = pool if chunks is None else pool.join(chunks.select("chunk_ord", "title", F.substring("text", 1, prompts.RANK_CHARS).alias("text")), "chunk_ord")
    n = pool.groupBy("question_id").agg(F.count("*").alias("n"))
    lists = prompts.listing(listed, prompts.RANK_CHARS, "question_id").join(n, "question_id").join(questions.select("question_id", "question"), "question_id")
    prompt = prompts.ranking(F.col("question"), F.col("listing"), F.col("n"))
    if chunks is None or path is not None:
        out = ask(lists.withColumn("prompt", prompt), client, RANK, path, chars=prompts.RANK_CHARS)
    else:
        files.shared_folder(pool.sparkSession)
        out = replied(lists, prompt, client, RANK).select("question_id", "n", "reply").checkpoint()
    order = out.select("question_id", F.posexplode(scored_ranking(F.col("reply"), F.col("n"))).alias("model_pos", "_r"))
    order = order.select("question_id", "model_pos", F.col("_r.index").alias("local_idx"), F.col("_r.score").alias("rerank_score"))
    rows = pool.withColumn("local_idx", F.col("rank") - 1).drop("rank")
    return ranking.rerank_fill(rows, order, "question_id", top)


@dataclass(frozen=True)
class Clients:
    expand: ModelClient
    rank: ModelClient
    answer: ModelClient
    judge: ModelClient

    def __post_init__(self) -> None:
        if self.judge.name == self.answer.name:
            raise ValueError("the judge must be another model than the generator")


STUBS = Clients(ExpandStub(), RankStub(), AnswerStub(), JudgeStub())


def rerank(questions: DataFrame, chunks: DataFrame, clients: Clients, expand: bool = True, top: int | None = search.TOP, candidates: int = CANDIDATES, index=None, path: str | None = None) -> DataFrame:
    """Full chunk rows in the model's order with rerank_score: pool by BM25 for the expanded question (or the plain one), then the ranking.
    This is also the context of an answer: no diversity cap."""
    asked, texts = once(questions)
    return spread(_with_text(_ranks(texts, chunks, clients, expand, top, candidates, index, path), chunks), asked)


def _ranks(texts: DataFrame, chunks: DataFrame, clients: Clients, expand: bool = True, top: int | None = search.TOP, candidates: int = CANDIDATES, index=None, path: str | None = None) -> DataFrame:
    """question_id, chunk_ord, rerank_score, rank for questions with distinct texts. Until the ranks are known a chunk's text goes no further than
    into the prompt."""
    if path is not None and expand:
        queries = expanded(texts, clients.expand, path=f"{path}/expand")
    elif expand:
        queries = replied(texts, prompts.expansion(F.col("question")), clients.expand, EXPAND).select("question_id", F.concat_ws(" ", "question", "reply").alias("query")).checkpoint()
    else:
        queries = texts.withColumnRenamed("question", "query")
    pool = search.pool(chunks, queries, candidates, "question_id", index).drop("score").checkpoint()  # read by the prompt and by its reply
    return reranked(pool, texts, clients.rank, top, path and f"{path}/rank", chunks).drop("local_idx")


def _with_text(ranks: DataFrame, chunks: DataFrame, *more: str) -> DataFrame:
    return ranks.join(chunks.select("chunk_ord", *(more or search.RESULT)), "chunk_ord")


def answered(context: DataFrame, questions: DataFrame, client: ModelClient, path: str | None = None) -> DataFrame:
    """question_id, question, answer from the passages of a context; a question without one is answered from nothing."""
    rows = questions.select("question_id", "question").join(prompts.listing(context, prompts.READ_CHARS, "question_id"), "question_id", "left")
    out = ask(rows.withColumn("prompt", prompts.answering(F.col("question"), F.coalesce("listing", F.lit("")))), client, ANSWER, path, chars=prompts.READ_CHARS)
    return out.select("question_id", "question", strip(F.col("reply")).alias("answer"))


@F.pandas_udf(T.DoubleType())
def score_in(reply: pd.Series) -> pd.Series:
    """The score of a judge's reply within [0, 1]; what is no number counts as 0, null if there is no score to read."""

    def one(text):
        v = last_json(text)
        if not isinstance(v, dict) or "score" not in v:
            return None
        try:
            x = float(v["score"])
        except (TypeError, ValueError):
            return 0.0
        return min(1.0, max(0.0, x)) if x == x else 0.0

    return reply.map(one).astype("float64")


@F.pandas_udf(T.DoubleType())
def share_in(reply: pd.Series) -> pd.Series:
    """The share of ones among the readable marks of a judge's reply; null if there are none."""
    bits = reply.map(lambda t: flags_of(last_json(t)))
    return bits.map(lambda b: sum(b) / len(b) if b else None).astype("float64")


def _verdicts(listing: str) -> tuple:
    """Name, system, prompt and reader of each verdict."""
    return (
        ("faithfulness", SUPPORT, prompts.support(F.col(listing), F.col("answer")), score_in),
        ("answer_relevance", FIT, prompts.fit(F.col("question"), F.col("answer")), score_in),
        ("context_precision", USE, prompts.use(F.col("question"), F.col(listing)), share_in),
    )


def judged(answers: DataFrame, context: DataFrame, client: ModelClient, path: str | None = None) -> DataFrame:
    """question_id, faithfulness, answer_relevance, context_precision: three verdicts on each answer, null where a verdict cannot be read. The
    judge sees the passages without titles."""
    rows = answers.join(prompts.listing(context, prompts.READ_CHARS, "question_id", with_title=False), "question_id", "left").withColumn("listing", F.coalesce("listing", F.lit("")))
    out = rows.select("question_id")
    for name, system, prompt, read in _verdicts("listing"):
        got = ask(rows.select("question_id", prompt.alias("prompt")), client, system, path, chars=prompts.READ_CHARS)
        out = out.join(got.select("question_id", read("reply").alias(name)), "question_id")
    return out


def _answered_once(texts: DataFrame, chunks: DataFrame, clients: Clients, index, with_plain: bool = False) -> DataFrame:
    """question_id, question, listing and answer for questions with distinct texts; `plain` is the listing without titles."""
    context = _with_text(_ranks(texts, chunks, clients, index=index), chunks, "title", "text")
    lists = prompts.listing(context, prompts.READ_CHARS, "question_id")
    if with_plain:
        lists = lists.join(prompts.listing(context, prompts.READ_CHARS, "question_id", with_title=False).withColumnRenamed("listing", "plain"), "question_id")
    rows = texts.join(lists, "question_id", "left")
    return replied(rows, prompts.answering(F.col("question"), F.coalesce("listing", F.lit(""))), clients.answer, ANSWER).withColumn("answer", strip(F.col("reply")))


def answers(questions: DataFrame, chunks: DataFrame, clients: Clients, index=None) -> DataFrame:
    """question_id, question, answer: context and answer for each question, worked out once for each text."""
    asked, texts = once(questions)
    files.shared_folder(chunks.sparkSession)
    out = _answered_once(texts, chunks, clients, index).select("question_id", "answer").checkpoint()
    return spread(out, asked).join(asked.select("question_id", "question"), "question_id").select("question_id", "question", "answer")


def cell(questions: DataFrame, chunks: DataFrame, clients: Clients, index=None, path: str | None = None) -> DataFrame:
    """Context, answer and three verdicts for each question, worked out once for each text."""
    files.shared_folder(chunks.sparkSession)
    if path is not None:
        context = rerank(questions, chunks, clients, index=index, path=path).checkpoint()  # read by the answer and by two judges
        return judged(answered(context, questions, clients.answer, f"{path}/answer"), context, clients.judge, f"{path}/judge")
    asked, texts = once(questions)
    out = _answered_once(texts, chunks, clients, index, with_plain=True).withColumn("plain", F.coalesce("plain", F.lit("")))
    for name, system, prompt, _ in _verdicts("plain"):
        out = replied(out, prompt, clients.judge, system, name)
    out = out.select("question_id", *[read(name).alias(name) for name, _, _, read in _verdicts("plain")]).checkpoint()
    return spread(out, asked).select("question_id", *[name for name, *_ in _verdicts("plain")])


def parsed_question(text: str | None) -> dict | None:
    """question and answer of a generator's reply, stripped; None unless both are non-empty strings."""
    v = last_json(text)
    if not isinstance(v, dict) or not all(isinstance(v.get(k), str) and v[k].strip() for k in ("question", "answer")):
        return None
    return {"question": v["question"].strip(), "answer": v["answer"].strip()}


@F.pandas_udf(T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())]))
def question_in(reply: pd.Series) -> pd.DataFrame:
    rows = [parsed_question(t) or {} for t in reply]
    return pd.DataFrame({k: [r.get(k) for r in rows] for k in ("question", "answer")})


def generated(chunks: DataFrame, client: ModelClient, done: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Question rows for chunks (chunk_id, arxiv_id, title, section, text): question, reference answer, type of the section and the share of the
    question's tokens that the chunk has. Chunks of `done` (source_chunk_id) are not asked again; unreadable replies give no row."""
    todo = chunks if done is None else chunks.join(done.select(F.col("source_chunk_id").alias("chunk_id")), "chunk_id", "left_anti")
    out = ask(todo.withColumn("prompt", prompts.asking(F.col("title"), F.col("text"))), client, ASK, path, chars=prompts.READ_CHARS).withColumn("_q", question_in("reply")).filter("_q.question IS NOT NULL")
    return out.select(
        F.col("chunk_id").alias("question_id"), F.col("_q.question").alias("question"), F.col("_q.answer").alias("reference_answer"), F.col("chunk_id").alias("source_chunk_id"), "arxiv_id", "section",
        section_type(F.col("section")).alias("section_type"), F.round(overlap(F.col("_q.question"), F.col("text")), 3).alias("overlap"),
    )


# --- evaluation of whole pipelines ---------------------------------------------------------------------------------------------------


def arm_ranks(arm: str, questions: DataFrame, chunks: DataFrame, clients: Clients, n: int, index=None, vectors: DataFrame | None = None, candidates: int = CANDIDATES, path: str | None = None) -> DataFrame:
    """question_id, rank, chunk_ord of one pipeline for all questions: bm25, hyde, rerank, rerank_nohyde; dense and dense_rerank take the
    question's vector (`embedding`) against vectors of chunks (chunk_ord, embedding)."""
    asked = questions.select("question_id", "question")
    if arm in ("rerank", "rerank_nohyde"):
        return rerank(questions, chunks, clients, arm == "rerank", None, candidates, index, path).select("question_id", "rank", "chunk_ord")
    if arm in ("bm25", "hyde"):
        queries = asked.withColumnRenamed("question", "query") if arm == "bm25" else expanded(asked, clients.expand, path=path and f"{path}/expand")
        return search.pool(chunks, queries, n, "question_id", index).select("question_id", "rank", "chunk_ord")
    if arm not in ("dense", "dense_rerank") or vectors is None:
        raise ValueError(f"no such pipeline: {arm}")
    own = questions.select("question_id", F.xxhash64("question_id").alias("chunk_ord"), "embedding")
    found = dense.top_dense(vectors, own, n if arm == "dense" else candidates, "chunk_ord").join(own.select(F.col("chunk_ord").alias("query_id"), "question_id"), "query_id").drop("query_id")
    if arm == "dense":
        return found.select("question_id", "rank", "chunk_ord")
    pool = search.with_provenance(found, chunks, "question_id").drop("score")
    return reranked(pool, asked, clients.rank, None, path and f"{path}/rank").select("question_id", "rank", "chunk_ord")


#: The pipelines over text: whether the question is expanded, and whether a model ranks.
TEXT_ARMS = {"bm25": (False, False), "hyde": (True, False), "rerank": (True, True), "rerank_nohyde": (False, True)}


def text_arms(arms: tuple[str, ...], questions: DataFrame, chunks: DataFrame, clients: Clients, n: int, index=None, candidates: int = CANDIDATES) -> dict[str, DataFrame]:
    """question_id, rank, chunk_ord of each pipeline over text, as arm_ranks gives them: one search for plain and expanded questions together, and
    one ranking."""
    asked, texts = once(questions)
    rows = texts.select(F.concat(F.lit("p|"), "question_id").alias("question_id"), "question", F.col("question").alias("query"))
    more = replied(texts, prompts.expansion(F.col("question")), clients.expand, EXPAND)
    both = rows.unionByName(more.select(F.concat(F.lit("h|"), "question_id").alias("question_id"), "question", F.concat_ws(" ", "question", "reply").alias("query"))).checkpoint()
    pool = search.pool(chunks, both, max(n, candidates), "question_id", index).drop("score").checkpoint()
    order = reranked(pool.filter(F.col("rank") <= candidates), both, clients.rank, None, None, chunks)
    out = {}
    for arm in arms:
        hyde, ranked = TEXT_ARMS[arm]
        own = (order if ranked else pool.filter(F.col("rank") <= n)).filter(F.col("question_id").startswith("h|" if hyde else "p|"))
        out[arm] = spread(own.select(F.expr("substr(question_id, 3)").alias("question_id"), "rank", "chunk_ord"), asked)
    return out


def arm_scores(arms: tuple[str, ...], questions: DataFrame, chunks: DataFrame, clients: Clients, k: int, **more) -> DataFrame:
    """question_id, config and the four retrieval metrics, one row per question and pipeline. questions: question_id, question,
    source_chunk_id, gold_paper."""
    ids = chunks.select("chunk_ord", "chunk_id", "arxiv_id")
    files.shared_folder(chunks.sparkSession)
    questions = questions.checkpoint()  # read by every pipeline
    text = tuple(arm for arm in arms if arm in TEXT_ARMS and more.get("path") is None)
    known = text_arms(text, questions, chunks, clients, k, **{x: more[x] for x in ("index", "candidates") if x in more}) if text else {}
    out = None
    for arm in arms:
        ranks = known[arm] if arm in known else arm_ranks(arm, questions, chunks, clients, k, **more)
        got = metrics.question_scores(ranks.filter(F.col("rank") <= k).join(ids, "chunk_ord"), questions, k).withColumn("config", F.lit(arm))
        out = got if out is None else out.unionByName(got)
    return out
