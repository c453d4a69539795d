"""Encoding of a corpus with a public byte-level BPE through a table of its distinct words.

A *word* here is a run of white space with the run of other characters after it. A byte-level BPE never joins the two sides of a change from a
non-blank to a blank character, so a text's ids are the ids of its words in a row. Each distinct word is encoded once, in a table; the ids are
joined back by position:

* the most frequent words (a fixed number, of bounded length, so of bounded size) go to the tasks as a broadcast and are put in place there;
* every other word travels as (document, place, word), meets the table in a shuffled join, and comes back to its document.

No group grows with the data: a frequent word is never shuffled by its occurrences, and a rare one has few.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.store import most_frequent, saved, sliced, written

#: White space by Unicode; the set has not changed for many versions of the standard, unlike the letters.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")


@dataclass(frozen=True)
class TokenizerParams:
    path: str = "/opt/tokenizers/byte_bpe_50k.json"
    frequent: int = 131072  # words in the broadcast part
    frequent_chars: int = 32  # longest word in it: bounds its size


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: distinct words with their number of occurrences. Counted a batch at a time before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in sliced(batches):
            for t in b.column(0).to_pylist():
                if t:
                    held.update(WORD.findall(t))
            if len(held) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                held = Counter()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    return docs.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, text: str = "text", p: TokenizerParams = TokenizerParams()) -> DataFrame:
    """word, n, ids: each distinct word of the corpus encoded once. Written to the shared folder, since it is read three times."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(p.path)
        for b in sliced(batches):
            ids = [e.ids for e in tok.encode_batch_fast(b.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return saved(word_counts(docs, text).mapInArrow(encode, "word string, n bigint, ids array<int>"))


def _frequent(table: DataFrame, p: TokenizerParams) -> list:
    short = table.filter(F.length("word") <= p.frequent_chars)
    return most_frequent(short, "n", p.frequent).select("word", "ids").collect()


def _broadcast(docs: DataFrame, table: DataFrame, p: TokenizerParams):
    """(words, starts, lengths, ids) of the frequent words; the last entry stands for any other word and is -1."""
    rows = _frequent(table, p)
    ids = [r["ids"] for r in rows] + [[-1]]
    lengths = np.array([len(i) for i in ids], np.int32)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    flat = np.fromiter(chain.from_iterable(ids), np.int32)
    return docs.sparkSession.sparkContext.broadcast(([r["word"] for r in rows], starts, lengths, flat))


def _coded(texts: list, index: dict, other: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Words of all texts in a row, their entry numbers, and the number of words of each text."""
    per = [WORD.findall(t) if t else [] for t in texts]
    words = list(chain.from_iterable(per))
    codes = np.fromiter((index.get(w, other) for w in words), np.int32, len(words))
    return words, codes, np.fromiter(map(len, per), np.int64, len(per))


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _list(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_offsets(lengths), pa.int32()), values)


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", p: TokenizerParams = TokenizerParams()) -> DataFrame:
    """key, ids: the token ids of each text without special tokens, one row per row of docs.

    A null text and an empty text have the empty list. Strings that look like special tokens are ordinary text. Repeated rows each come out;
    rows with a null key and rows that share a key keep their own ids, since they are also told apart by a hash of the text. Other columns
    are not read.
    """
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    table = word_table(rows, "_t", p)
    own = _broadcast(docs, table, p)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, starts, lengths, flat = own.value
        index, other = {w: i for i, w in enumerate(words_)}, len(words_)
        for b in sliced(batches):
            words, codes, n = _coded(b.column(2).to_pylist(), index, other)
            each = lengths[codes]
            at = np.repeat(starts[codes] - _offsets(each)[:-1], each) + np.arange(each.sum())
            doc = np.repeat(np.arange(len(n)), n)
            rest = np.flatnonzero(codes == other)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    _list(pa.array(flat[at], pa.int32()), np.bincount(doc, each, len(n)).astype(np.int64)),
                    _list(pa.array([words[i] for i in rest], pa.string()), np.bincount(doc[rest], minlength=len(n))),
                ],
                ["_k", "_h", "_i", "_w"],
            )

    kind = docs.schema[key].dataType.simpleString()
    keyed = rows.select("_k", F.xxhash64("_t").alias("_h"), "_t")
    placed = written(keyed.mapInArrow(place, f"_k {kind}, _h bigint, _i array<int>, _w array<string>").withColumn("_more", F.size("_w") > 0))
    open_ = placed.filter("_more")  # only texts with other words are shuffled
    rest = open_.select("_k", "_h", F.posexplode("_w").alias("_p", "word"))
    found = rest.join(table.select("word", "ids"), "word").groupBy("_k", "_h").agg(F.array_sort(F.collect_set(F.struct("_p", "ids"))).alias("_f"))
    found = found.select(F.col("_k").alias("_k2"), F.col("_h").alias("_h2"), F.col("_f.ids").alias("_f"))

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out, lengths = [], []
            for ids, more in zip(b.column(1), b.column(2)):
                a = ids.values.to_numpy(zero_copy_only=False)
                if more.is_valid:
                    gaps = np.flatnonzero(a == -1)
                    n = np.ones(len(a), np.int64)
                    n[gaps] = np.diff(more.values.offsets.to_numpy())
                    full = np.repeat(a, n)
                    full[full == -1] = more.values.flatten().to_numpy()
                    a = full
                out.append(a)
                lengths.append(len(a))
            yield pa.RecordBatch.from_arrays([b.column(0), _list(pa.array(np.concatenate(out) if out else [], pa.int32()), np.array(lengths, np.int64))], [key, "ids"])

    joined = open_.select("_k", "_h", "_i").join(found, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_h") == F.col("_h2")))
    done = placed.filter("NOT _more").select(F.col("_k").alias(key), F.col("_i").alias("ids"))
    return joined.select("_k", "_i", "_f").mapInArrow(splice, f"`{key}` {kind}, ids array<int>").unionByName(done)


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", p: TokenizerParams = TokenizerParams()) -> DataFrame:
    """key, n_tokens: as `encoded`, but only the number of ids; a key that occurs more than once gets one row with the sum over its rows.
    Rows with a null key are left out. Null and empty texts have 0."""
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    table = word_table(rows, "_t", p)
    own = _broadcast(docs, table, p)
    kind = docs.schema[key].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, _, lengths, _ = own.value
        index, other = {w: i for i, w in enumerate(words_)}, len(words_)
        lengths = np.concatenate([lengths[:-1], [0]])
        for b in sliced(batches):
            words, codes, n = _coded(b.column(1).to_pylist(), index, other)
            doc = np.repeat(np.arange(len(n)), n)
            rest = np.flatnonzero(codes == other)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.bincount(doc, lengths[codes], len(n)).astype(np.int64)), _list(pa.array([words[i] for i in rest], pa.string()), np.bincount(doc[rest], minlength=len(n)))],
                ["_k", "_n", "_w"],
            )

    placed = written(rows.mapInArrow(place, f"_k {kind}, _n bigint, _w array<string>"))
    rest = placed.filter(F.size("_w") > 0).select("_k", F.explode("_w").alias("word"))
    more = rest.join(table.select("word", F.size("ids").cast("bigint").alias("_n")), "word").select("_k", "_n")
    return placed.select("_k", "_n").unionByName(more).groupBy("_k").agg(F.sum("_n").alias("n_tokens")).withColumnRenamed("_k", key)


def piece_table(path: str = TokenizerParams.path) -> list[bytes]:
    """Bytes of each id, by id."""
    import json

    spec = json.loads(Path(path).read_text())
    vocab = dict(spec["model"]["vocab"])
    vocab.update({t["content"]: t["id"] for t in spec.get("added_tokens", [])})
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    pieces = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        pieces[i] = bytes(of[c] for c in piece)
    return pieces


def decoded(rows: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = TokenizerParams.path, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of `keep`, text: ids back to text. The table of pieces has a fixed size, so it meets the ids inside each row, by number,
    without a shuffle. Bytes that are no UTF-8 become U+FFFD; null ids give null, an unknown id gives nothing."""
    types = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(path)
        for b in sliced(batches):
            out = [None if v is None else b"".join([pieces[i] for i in v if 0 <= i < len(pieces)]).decode("utf-8", "replace") for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(out, pa.string())], [key, *keep, "text"])

    own = rows.select(F.col(key), F.col(ids).alias("_ids"), *keep)
    return own.mapInArrow(run, ", ".join([*types, "text string"]))
