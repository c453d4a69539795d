"""Parsing of model replies: JSON inside prose, relevance flags, rankings. Not expressible in SQL, so Arrow-batched."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DECODER = json.JSONDecoder()


def last_json(text: str | None):
    """The last non-empty JSON object or array that stands in the text outside any other; None if there is none."""
    found, at = None, 0
    while text and at < len(text):
        nxt = min((p for p in (text.find("{", at), text.find("[", at)) if p >= 0), default=-1)
        if nxt < 0:
            break
        try:
            value, at = _DECODER.raw_decode(text, nxt)
        except (ValueError, RecursionError):
            at = nxt + 1
            continue
        found = value or found
    return found


#: Words of a judge and the keys under which a verdict may stand, in the order in which they are tried.
YES, NO = frozenset({"1", "true", "yes", "relevant"}), frozenset({"0", "false", "no", "irrelevant"})
VERDICT_KEYS = ("relevant", "relevance", "verdict", "label", "score")


def flag_of(value) -> int | None:
    while isinstance(value, dict):
        value = next((value[k] for k in VERDICT_KEYS if k in value), None)
    if isinstance(value, str):
        word = value.strip().lower()
        return 1 if word in YES else 0 if word in NO else None
    return int(bool(value)) if isinstance(value, (bool, int, float)) else None


def flags_of(value) -> list[int] | None:
    if isinstance(value, dict):
        own = value.get("relevant")
        value = own if isinstance(own, list) else next((v for v in value.values() if isinstance(v, list)), None)
    bits = [b for b in map(flag_of, value if isinstance(value, list) else []) if b is not None]
    return bits or None


def ranking_of(text: str | None, n: int) -> list[tuple[int, float]]:
    """(number, score) of the candidates in the model's order: out of range, malformed and repeated entries are skipped, and the missing ones follow
    in order with 0.0. The score never sorts."""
    rows = last_json(text)
    order: dict[int, float] = {}
    for row in rows if isinstance(rows, list) else []:
        try:
            i, score = int(row["index"]), float(row["score"])
        except (TypeError, KeyError, ValueError, OverflowError):
            continue
        if 0 <= i < n:
            order.setdefault(i, score)
    return [*order.items(), *((i, 0.0) for i in range(n) if i not in order)]


@F.pandas_udf(T.StringType())
def json_block(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if (v := last_json(t)) is None else json.dumps(v))


def _loaded(text):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


@F.pandas_udf(T.IntegerType())
def json_flag(value: pd.Series) -> pd.Series:
    return value.map(lambda t: flag_of(_loaded(t))).astype("Int32")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def json_flags(value: pd.Series) -> pd.Series:
    return value.map(lambda t: flags_of(_loaded(t)))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("score", T.DoubleType())])))
def scored_ranking(text: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([[{"index": i, "score": s} for i, s in ranking_of(t, int(k))] for t, k in zip(text, n)])
