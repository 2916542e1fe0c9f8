"""Where models plug in: embeddings, reranking, reviews. Each has an offline default, which is named as such.

Calls of a model may fail: ``called`` tries batches again, falls back to other models, splits a bad batch into its items, and gives the
error of an item that still fails beside the results of all others, in one pass.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_embedding(text: str | None, dims: int = 64) -> list[float]:
    """The offline default for embeddings: words hashed to signed dimensions, scaled to length 1. Not a language model."""
    v = np.zeros(dims)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        v[h % dims] += 1 if h >> 31 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed(df: DataFrame, text: str = "text", embed_batch: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """``df`` with ``embedding``; ``embed_batch`` is a provider for lists of texts, called once for each Arrow batch."""

    @F.pandas_udf("array<double>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(embed_batch(texts.tolist()) if embed_batch else [hashed_embedding(t) for t in texts])

    return df.withColumn("embedding", of(text))


def overlap_score(query: F.Column, text: F.Column) -> F.Column:
    """The offline default for reranking: the share of the query's words that a text has. A substitute, not a cross-encoder."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    q = words(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(text))) / F.size(q)).otherwise(F.lit(0.0))


def reviewed(df: DataFrame, review: Callable[[pd.DataFrame], pd.DataFrame] | None, schema: str) -> DataFrame:
    """Rows that a reviewing model gives for batches of ``df``; without a model there are none."""
    if review is None:
        return df.sparkSession.createDataFrame([], schema)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(review, batches)

    return df.mapInPandas(of, schema)


@dataclass(frozen=True)
class Calls:
    """How a model is called: items of a batch, batches at once in a task, tries of a batch, and the seconds between them.

    The pause after try t (from 1) is ``wait`` x t (linear) or ``wait`` x ``factor`` ** (t - 1), if ``factor`` is given.
    """

    size: int = 15
    threads: int = 4
    tries: int = 3
    wait: float = 0.5
    factor: float | None = None

    def pause(self, t: int) -> float:
        return self.wait * (self.factor ** (t - 1) if self.factor else t)


def _tried(items: list, models: list[Callable[[list], list]], how: Calls, tries: int) -> tuple[list | None, str | None, int]:
    """Results of ``items`` from the first model that gives as many as there are items; else the last error; and how many calls it took."""
    error, n = None, 0
    for model in models:
        for t in range(1, tries + 1):
            n += 1
            try:
                out = list(model(items))
                if len(out) == len(items):
                    return out, None, n
                error = f"{len(out)} results for {len(items)} items"
            except Exception as e:
                error = str(e) or type(e).__name__
            if t < tries:
                time.sleep(how.pause(t))
    return None, error, n


def answers(items: list, models: list[Callable[[list], list]], how: Calls) -> list[tuple[object, str | None, int]]:
    """For each item its result, or the error, and the calls that it was in."""
    out, error, n = _tried(items, models, how, how.tries)
    if out is not None:
        return [(x, None, n) for x in out]
    if len(items) == 1:
        return [(None, error, n)]
    found = []
    for item in items:  # what is bad about the batch may be one item's fault
        one, error, k = _tried([item], models, how, 1)
        found.append((one[0] if one is not None else None, error, n + k))
    return found


def called(df: DataFrame, column: str, models: list[Callable[[list], list]], kind: str, how: Calls = Calls()) -> DataFrame:
    """``df`` with ``result`` (of type ``kind``), ``error`` and ``calls``, one row for each: all items that ``models`` can do have a result, the others an error.

    ``models`` take a list of ``column``'s values and give as many results; later ones are fall-backs. Where a call fails, only the
    items that fail alone are lost. Columns of ``df`` that are called like the new ones give way.
    """
    own = df.drop("result", "error", "calls")

    @F.pandas_udf(f"result {kind}, error string, calls int")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(how.threads) as pool:
            for part in parts:
                items = [None if x is None or x is pd.NA else x for x in part.tolist()]
                batches = [items[i : i + how.size] for i in range(0, len(items), how.size)]
                rows = [x for got in pool.map(lambda b: answers(b, models, how), batches) for x in got]
                yield pd.DataFrame(rows, columns=["result", "error", "calls"])

    return own.withColumn("_m", of(column)).select(*own.columns, "_m.result", "_m.error", "_m.calls")


def accepted(df: DataFrame, column: str, models: list[Callable[[list], list]], how: Calls = Calls(size=10)) -> DataFrame:
    """``df`` with ``accepted``: what a checking model says of each item; a check that fails, or says nothing, is a no."""
    out = called(df, column, models, "boolean", how)
    return out.withColumn("accepted", F.coalesce("result", F.lit(False))).drop("result", "error", "calls")


def doubled_words(limit: int) -> Callable[[list], list]:
    """The offline default for a grammar review: how often a word stands twice in a row. As models do, it refuses texts of more than ``limit`` characters."""

    def of(texts: list[str | None]) -> list[int]:
        out = []
        for t in texts:
            if len(t or "") > limit:
                raise ValueError("text too long")
            w = (t or "").split(" ")
            out.append(sum(a == b != "" for a, b in zip(w, w[1:])))
        return out

    return of
