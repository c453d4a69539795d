"""Fetching and decoding of papers. The network and format libraries are injected, so every step can be run and tested without them."""

from __future__ import annotations

import gzip
import io
import tarfile
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (status, body) of one address; raises OSError if the network fails.
Get = Callable[[str], tuple[int, bytes]]


@dataclass(frozen=True)
class Backoff:
    start: float = 5.0
    most: float = 120.0
    tries: int = 6
    again: tuple[int, ...] = (429, 503)


def fetch(url: str, get: Get, b: Backoff = Backoff(), sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """Body of an address; None for another status than 200 or after the last try. Waits double from start to most."""
    for attempt in range(b.tries):
        try:
            status, body = get(url)
        except OSError:
            status = None
        if status == 200:
            return body
        if status is not None and status not in b.again:
            return None
        sleep(min(b.start * 2**attempt, b.most))
    return None


def fetched(urls: DataFrame, get: Get, key: str = "arxiv_id", b: Backoff = Backoff(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """key, body, failed for each row with `url`, fetched in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            body = [fetch(u, get, b, sleep) if u else None for u in d["url"]]
            yield pd.DataFrame({key: d[key], "body": body, "failed": [x is None for x in body]})

    return urls.select(key, "url").mapInPandas(run, f"{key} string, body binary, failed boolean")


def batch_lookup(ids: DataFrame, lookup: Callable[[list[str]], list[dict | None]], key: str = "arxiv_id", size: int = 100) -> DataFrame:
    """Rows of an external batch service for ids, `size` at a time; status found, missing or failed. A failed batch is marked so that a later
    run asks again, unlike an id that the service does not know."""
    schema = f"{key} string, status string, citations int, fields array<string>, tldr string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            todo = list(d[key])
            for at in range(0, len(todo), size):
                part = todo[at : at + size]
                try:
                    got = lookup(part)
                    state = ["found" if g is not None else "missing" for g in got]
                except OSError:
                    got, state = [None] * len(part), ["failed"] * len(part)
                rows = [g or {} for g in got]
                yield pd.DataFrame(
                    {
                        key: part,
                        "status": state,
                        "citations": pd.array([r.get("citationCount") or 0 for r in rows], "Int32"),
                        "fields": [r.get("fieldsOfStudy") or [] for r in rows],
                        "tldr": [(r.get("tldr") or {}).get("text") for r in rows],
                    }
                )

    return ids.select(key).mapInPandas(run, schema)


def main_tex(blob: bytes | None) -> str | None:
    r"""The main LaTeX file of a source archive: most \section marks, 100 more for a \documentclass; the first of equals. A PDF gives None,
    a gzip that is no archive its only file."""
    if not blob or blob[:4] == b"%PDF":
        return None
    try:
        with tarfile.open(fileobj=io.BytesIO(blob), mode="r:*") as tar:
            files = [tar.extractfile(m).read() for m in tar if m.isfile() and m.name.endswith(".tex")]
    except (tarfile.TarError, EOFError, zlib.error):
        try:
            files = [gzip.decompress(blob)]
        except (OSError, EOFError, zlib.error):
            return None
    texts = [f.decode("utf-8", "ignore") for f in files]
    weight = [t.count("\\section") + 100 * ("\\documentclass" in t) for t in texts]
    return texts[weight.index(max(weight))] if texts else None


@F.pandas_udf(T.StringType())
def tex_of(blob: pd.Series) -> pd.Series:
    return blob.map(main_tex)


def pdf_text(blob: bytes | None, pages: Callable[[bytes], list[str]]) -> str | None:
    """Pages of a PDF joined by line ends and stripped; None if it is none, is empty or cannot be read."""
    if not blob or blob[:4] != b"%PDF":
        return None
    try:
        return "\n".join(pages(blob)).strip() or None
    except Exception:  # noqa: BLE001 - whatever an extractor raises on a broken file
        return None


def plain(raw: str, detex: Callable[[str], str] | None = None) -> str:
    """LaTeX as text by an injected converter; the raw text, stripped, without one or if it fails."""
    try:
        return (detex(raw) if detex else raw).strip()
    except Exception:  # noqa: BLE001
        return raw.strip()


def fallback(latex, pdf):
    """(sections, kind): LaTeX if it has any, else PDF, else an empty array and 'failed'. Columns of arrays of sections."""
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    kind = F.when(has(latex), "latex").when(has(pdf), "pdf").otherwise("failed")
    return F.when(has(latex), latex).when(has(pdf), pdf), kind
