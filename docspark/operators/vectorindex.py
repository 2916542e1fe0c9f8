"""An index of vectors by inverted lists, searched by likeness to the lists' centres, with exact cosines of what is found.

Centres are learnt by k-means on unit vectors from a bounded sample; every vector is in the list of its nearest centre. Lists are
cut into cells of bounded size, so a list that many vectors crowd into is many tasks' work, and none is dropped. A vector that asks
goes to the ``probes`` lists whose centres are nearest to it, is compared exactly with all vectors there, and keeps the best of
all. Where results must be exact, it then goes to every other list that can hold a better one: by the triangle inequality of
angles, no vector of a list is nearer than its centre's angle less the list's radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.knn import _best, _unit
from docspark.operators.tables import written

#: Vectors that centres are learnt from, at most but for chance; steps of k-means; vectors of a cell.
SAMPLE, STEPS, CELL = 50_000, 12, 4096


def _ready(df: DataFrame) -> DataFrame:
    df = df.where(F.col("vec_id").isNotNull() & F.exists("embedding", lambda v: v != 0))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def centres(sample: np.ndarray, n: int, steps: int = STEPS, seed: int = 7) -> np.ndarray:
    """``n`` unit centres by spherical k-means; an empty one moves to the vector that is farthest from its own."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(steps):
        s = sample @ c.T
        own = s.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        sums[empty] = sample[np.argsort(s.max(1))[: len(empty)]]
        c = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-12)
    return c


@dataclass
class Index:
    """``rows(list, cell, vec_id, embedding)``; ``cells(list, n)``: in how many cells each list is; on the driver the centres and the lists' radii, -1 if empty."""

    rows: DataFrame
    cells: DataFrame
    centres: np.ndarray
    radii: np.ndarray


def _lists(c: np.ndarray, spark, radii: np.ndarray | None = None, probes: int = 1):
    """For each vector its nearest list and the angle to it; with ``radii``, a function of the least similarity too, the lists to ask.

    Without a least similarity these are the ``probes`` nearest, with one all others that can hold one as high.
    """
    sent = spark.sparkContext.broadcast((c, radii))  # of the size that ``build`` was asked for, whatever the number of rows

    def angles(vectors: pd.Series) -> np.ndarray:
        return np.arccos(np.clip(_unit(vectors) @ sent.value[0].T, -1, 1)) if len(vectors) else np.zeros((0, len(c)))

    @F.pandas_udf("list int, angle double")
    def own(vectors: pd.Series) -> pd.DataFrame:
        a = angles(vectors)
        return pd.DataFrame({"list": a.argmin(1).astype(np.int32), "angle": a.min(1)})

    @F.pandas_udf("array<int>")
    def ask(vectors: pd.Series, least: pd.Series) -> pd.Series:
        a, r = angles(vectors), sent.value[1]
        order, out = np.argsort(np.where(r < 0, np.inf, a), axis=1, kind="stable"), []
        for row, near, x in zip(a, order, least):
            if x is None or np.isnan(x):
                out.append(near[:probes].astype(np.int32))
            else:
                rest = near[probes:]
                out.append(rest[(r[rest] >= 0) & (np.cos(np.maximum(0, row[rest] - r[rest])) + 2e-6 >= x)].astype(np.int32))
        return pd.Series(out, dtype=object)

    return own if radii is None else ask


def build(vectors: DataFrame, lists: int = 64, sample: int = SAMPLE, cell: int = CELL) -> Index:
    """An index of all ``vectors(vec_id, embedding)``; those without an id, and null, empty or zero ones, aren't in it.

    The driver holds about ``sample`` vectors, drawn by a hash of their ids, while centres are learnt, and ``lists`` of them later.
    """
    spark, own = vectors.sparkSession, _ready(vectors)
    total = own.count()
    place = F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30))
    drawn = own.where(place < int(min(1.0, sample / max(1, total)) * (1 << 30))).orderBy("vec_id").toPandas() if total else None
    c = centres(_unit(drawn["embedding"]), lists) if drawn is not None and len(drawn) else np.zeros((0, 1))
    if not len(c):
        empty = own.limit(0)
        return Index(empty.select(F.lit(0).alias("list"), F.lit(0).alias("cell"), "*"), empty.select(F.lit(0).alias("list"), F.lit(0).alias("n")), c, np.zeros(0))
    dealt = written(own.withColumn("_l", _lists(c, spark)("embedding")).select("vec_id", "embedding", "_l.list", "_l.angle"), "vector-lists")
    cells = written(dealt.groupBy("list").agg(F.ceil(F.count("*") / cell).cast("int").alias("n"), F.max("angle").alias("radius")), "vector-cells")  # a row a list
    radii = np.full(len(c), -1.0)
    for r in cells.collect():
        radii[r.list] = r.radius + 1e-9
    rows = dealt.join(F.broadcast(cells), "list").withColumn("cell", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int"))
    return Index(rows.select("list", "cell", "vec_id", "embedding"), cells.select("list", "n"), c, radii)


def _compared(index: Index, to: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each list and cell for ``to(vec_id, embedding, list)``; no group is larger than a cell on either side."""
    to = to.join(F.broadcast(index.cells), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("cell"), "vec_id", "embedding")
    parts = written(to.groupBy("list").agg(F.ceil(F.countDistinct("vec_id") / CELL).cast("int").alias("m")), "asking-cells")
    to = to.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("m")).cast("int"))
    rows = index.rows.join(F.broadcast(parts), "list").select("list", "cell", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("part"), "vec_id", "embedding")
    keys = ["list", "cell", "part"]
    return to.select(*keys, "vec_id", "embedding").groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(_best(k), "query_id long, vec_id long, similarity double")


def search(index: Index, asking: DataFrame, k: int, probes: int, exact: bool = False) -> DataFrame:
    """Rows ``(query_id, vec_id, similarity, rnk)``: of each vector of ``asking`` the ``k`` of highest cosine in its ``probes`` lists, ties by id.

    With ``exact``, or as many probes as lists, they are the best of all. A vector doesn't find its own id.
    """
    spark, own = asking.sparkSession, _ready(asking)
    if not len(index.centres):
        return spark.createDataFrame([], "query_id long, vec_id long, similarity double, rnk int")
    ask = _lists(index.centres, spark, index.radii, probes)
    best = _compared(index, own.select("vec_id", "embedding", F.explode(ask("embedding", F.lit(None).cast("double"))).alias("list")), k)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    top = lambda df: df.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)
    if not exact:
        return top(best)
    first = written(top(best), "nearest-first")
    least = first.where(F.col("rnk") == k).select(F.col("query_id").alias("vec_id"), F.col("similarity").alias("least"))
    again = own.join(least, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))  # fewer than k: every list
    rest = _compared(index, again.select("vec_id", "embedding", F.explode(ask("embedding", "least")).alias("list")), k)
    return top(first.drop("rnk").unionByName(rest))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``(asked, expected, found, recall)``: which part of ``exact``'s pairs ``found`` has."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("asked"), F.count("*").alias("expected"), F.count("hit").alias("found"), (F.count("hit") / F.greatest(F.count("*"), F.lit(1))).alias("recall"))
