"""Helpers shared by the operators of this subpackage: the shared work folder, written tables and connected components."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators.tables import delete, new_path, written  # noqa: F401

#: One white-space-delimited word, by ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
#: Text in a range of ``by_size``, and for each mark that its borders are found by.
RANGE_BYTES, MARK_BYTES = 256 << 20, 16 << 10


def kept(kind: str, key, make: Callable):
    """``make()``, kept for later tasks of this Python worker under ``kind`` until another ``key`` comes.

    It is held by a module of its own, since functions of this package come to executors by value, anew for each task.
    """
    store = sys.modules.setdefault("_docspark_kept", types.ModuleType("_docspark_kept")).__dict__
    if kind not in store or store[kind][0] != key:
        store[kind] = (key, make())
    return store[kind][1]


def release() -> None:
    """At the end of a task: gives what a Python worker has freed back to the system, as workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def once(df: DataFrame, name: str, column) -> DataFrame:
    """``df`` with ``column``, worked out once a row: a generator, as a projection would be copied into all its uses."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def by_size(df: DataFrame, key: Column, size: Column, tie: Column, least: int | None = None) -> tuple[Callable, int, DataFrame]:
    """A function of key and tie that deals ``df`` to ranges of ``key`` (a long), of about equal sums of ``size`` (null: 0).

    There is a range for RANGE_BYTES, but ``least`` (``spark.sql.shuffle.partitions``) at least. Borders are quantiles of
    marks, of which a row has one for each MARK_BYTES on average. A key that fills several ranges is dealt over them by
    ``tie`` (a long, evenly spread), so ranges are in the order of key and tie. The driver holds a number for each border.
    Returned beside it: how many ranges there are at most, and a written table of key, size and tie.
    """
    spark = df.sparkSession
    light = written(df.select(key.alias("key"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), tie.alias("tie")), "sizes")
    total = light.agg(F.sum("size")).first()[0] or 0
    n = max(least or int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    part = F.pmod(F.xxhash64("key", "tie"), F.lit(MARK_BYTES))  # rounds up at random, so the mean is right
    marks = light.select("key", F.floor((F.col("size") + part) / MARK_BYTES).cast("int").alias("marks")).where("marks > 0").select("key", F.explode(F.sequence(F.lit(1), "marks")))
    shares = ",".join(repr(i / n) for i in range(1, n))  # one literal, as a plan with one for each border takes long to make
    cut = marks.agg(F.expr(f"percentile_approx(key, cast(split('{shares}', ',') as array<double>), {max(10_000, 10 * n)})")).first()[0] if n > 1 else None
    borders, times = np.unique(np.array(cut or [], np.int64), return_counts=True)
    # keys up to a border are one range; a border that comes several times has ranges of its own
    firsts = np.cumsum(np.where(times > 1, 1 + times, 1)) - np.where(times > 1, 1 + times, 1)
    last = int(firsts[-1] + (1 + times[-1] if times[-1] > 1 else 1)) if len(borders) else 0
    sent = spark.sparkContext.broadcast((borders, times, np.append(firsts, last)))

    @F.pandas_udf("int")
    def pid(keys: pd.Series, ties: pd.Series) -> pd.Series:
        borders, times, firsts = sent.value
        k = keys.to_numpy()
        at = np.searchsorted(borders, k, "left")
        out = firsts[at]
        hot = np.flatnonzero(at < len(borders))
        hot = hot[(borders[at[hot]] == k[hot]) & (times[at[hot]] > 1)]
        share = (ties.to_numpy()[hot] / 2.0**64 + 0.5) * times[at[hot]]
        out[hot] += 1 + np.minimum(share.astype(np.int64), times[at[hot]] - 1)
        return pd.Series(out.astype(np.int32))

    return pid, last + 1, light


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows ``(node, root)``, root the smallest node reachable.

    Alternating large-star and small-star steps; each round is a written table, so the plan stays short, and the tables of
    the round before are deleted. Minima are written too, so both sides of a star's join come as plain shuffles, of which
    skewed ones can be split. Nodes without an edge to another node don't appear; null ends, loops and repeated edges have
    no effect.
    """
    spark = edges.sparkSession

    def put(df: DataFrame) -> tuple[DataFrame, str]:
        df.write.parquet(path := new_path(spark, "edges"))
        return spark.read.schema(df.schema).parquet(path), path

    e, own = put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen or not now[0]:
            break
        seen = tuple(now)
        both = e.union(e.select("b", "a"))
        low, of_low = put(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large, of_large = put(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least, of_least = put(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        done = (own, of_low, of_large, of_least)
        e, own = put(small.distinct())
        for path in done:
            delete(spark, path)
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
