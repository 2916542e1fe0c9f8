"""Exact nearest vectors by blocks: every asking vector against every row, the best of each block, then the best of all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.tables import written

#: Vectors of a block, and of the share of those that ask that a task holds.
BLOCK = 16384
#: Fewest asking vectors for which a task of its own is worth while.
LEAST = 1024
#: Asking vectors and rows compared at a time, and pairs whose exact likeness is worked out at a time.
STEP, SLAB, PAIRS = 1024, 2048, 65536
PACKED = "no int, ids binary, vectors binary"


def _packed(block: int, kind: str):
    """Packs rows sorted by ``part`` into blocks of vectors of one part, as bytes."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        no = 0
        for pdf in batches:
            for part, rows in pdf.groupby("part", sort=False):
                for i in range(0, len(rows), block):
                    some = rows.iloc[i : i + block]
                    x = np.stack([np.asarray(v, kind) for v in some["embedding"]])
                    yield pd.DataFrame({"part": [part], "no": [no], "ids": [some["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()]})
                    no += 1

    return of


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _ordered(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and unit vectors, without those that have no finite length."""
    with np.errstate(all="ignore"):
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    good = np.flatnonzero(np.isfinite(x).all(axis=1))
    good = good[np.argsort(ids[good], kind="stable")]
    return ids[good], x[good]


def _unpacked(ids: bytes, vectors: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(ids, np.int64)
    return _ordered(n, np.frombuffer(vectors, kind).reshape(len(n), -1).astype(np.float64))


class _Best:
    """The ``k`` best rows so far of each asking vector of a block: likeness at six places, then the lower id.

    Likenesses are first taken in single precision; only what may be among the best by the bound of its error is worked out exactly.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k, n = ids, x, k, len(ids)
        self.single, self.error = x.astype(np.float32), np.float32((x.shape[1] + 8) * 2.0**-24 + 1e-6)
        self.likeness, self.found = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def see(self, ids: np.ndarray, y: np.ndarray) -> None:
        single = y.astype(np.float32)
        for b in range(0, len(ids), SLAB):
            at = slice(b, b + SLAB)
            lo, hi = np.searchsorted(ids[at], self.ids, "left"), np.searchsorted(ids[at], self.ids, "right")
            for a in range(0, len(self.ids), STEP):
                self._compare(a, single[at], ids[at], y[at], lo[a : a + STEP], hi[a : a + STEP])

    def _compare(self, a: int, single: np.ndarray, ids: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        s = self.single[a : a + STEP] @ single.T
        for q in np.flatnonzero(hi > lo):  # a vector doesn't find its own id
            s[q, lo[q] : hi[q]] = -np.inf
        low = self.likeness[a : a + STEP, -1].astype(np.float32) - self.error
        if len(new := np.flatnonzero(low == -np.inf)) and s.shape[1] > self.k:
            low[new] = np.partition(s[new], -self.k, axis=1)[:, -self.k] - 2 * self.error
        hit = s >= low[:, None]
        some = np.flatnonzero(hit.any(axis=1))
        ends = np.cumsum(np.count_nonzero(hit[some], axis=1))
        i = 0
        while i < len(some):  # so many askers at a time as have PAIRS pairs, one at least
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            self._merge(a, some[i:j], *np.nonzero(hit[some[i:j]]), ids, y)
            i = j

    def _merge(self, a: int, some: np.ndarray, r: np.ndarray, c: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        at = a + some
        other = self.ids[at[r]] != ids[c]
        r, c = r[other], c[other]
        exact = np.round(np.einsum("ij,ij->i", self.x[at[r]], y[c]), 6)
        k, n = self.k, len(some)
        row, value = np.concatenate([np.repeat(np.arange(n), k), r]), np.concatenate([self.likeness[at].ravel(), exact])
        vec = np.concatenate([self.found[at].ravel(), ids[c]])
        order = np.lexsort((vec, -value, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], np.arange(n))[row[order]]
        order = order[place < k]  # every asker has k, as those before count, found or not
        self.likeness[at], self.found[at] = value[order].reshape(n, k), vec[order].reshape(n, k)

    def rows(self) -> pd.DataFrame:
        q, i = np.nonzero(self.likeness > -np.inf)
        return pd.DataFrame({"query_id": self.ids[q], "vec_id": self.found[q, i], "similarity": self.likeness[q, i]})


def _best(k: int):
    """Of one group of asking vectors and one of rows."""

    def of(asking: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []}).astype({"query_id": "int64", "vec_id": "int64"})
        own = lambda df: _ordered(df["vec_id"].to_numpy(np.int64), np.stack([np.asarray(v, np.float64) for v in df["embedding"]]))
        best = _Best(*own(asking), k)
        best.see(*own(rows))
        return best.rows()

    return of


def _nearest(k: int, asks: str, kind: str):
    """From pairs of blocks, one that asks and one of rows; a task has few that ask and gets all that it compares them with one by one."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, _Best] = {}
        for pdf in batches:
            for no, ids, vectors, row_ids, row_vectors in pdf.itertuples(index=False, name=None):
                if no not in best:
                    best[no] = _Best(*_unpacked(ids, vectors, asks), k)
                best[no].see(*_unpacked(row_ids, row_vectors, kind))
        for b in best.values():
            yield b.rows()

    return of


def nearest(asking: DataFrame, rows: DataFrame, k: int, within: str | None = None, block: int = BLOCK) -> DataFrame:
    """Rows ``(query_id, vec_id, similarity, rnk)``: the ``k`` rows of highest cosine for each vector of ``asking``, ties by id.

    Both have ``vec_id`` and ``embedding``; with ``within``, a column of both, only rows of an equal value count. Vectors
    without an id, null, empty or zero ones, and those without a finite length, neither ask nor are found; a vector doesn't find its own id.

    Rows are written once as blocks of bytes, which every task reads from there: blocks aren't shuffled for each that asks, and of
    all pairs only the ``k`` best of an asking vector leave a task.
    """

    def ready(df: DataFrame) -> DataFrame:
        df = df.where(F.col("vec_id").isNotNull() & F.exists("embedding", lambda v: v != 0))
        return df.select((F.col(within) if within else F.lit(0)).alias("part"), F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("part is not null")

    def packed(df: DataFrame, n: int) -> tuple[DataFrame, str]:
        kind = "<f4" if df.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
        dealt = df.repartitionByRange(n, "part", "vec_id").sortWithinPartitions("part", "vec_id")
        return dealt.mapInPandas(_packed(block, kind), f"part {df.schema['part'].dataType.simpleString()}, {PACKED}"), kind

    asking, rows = ready(asking), ready(rows)
    n_asking, n_rows, tasks = asking.count(), rows.count(), 2 * asking.sparkSession.sparkContext.defaultParallelism
    of_asking, of_rows = max(1, -(-n_asking // block), min(tasks, -(-n_asking // LEAST))), max(1, -(-n_rows // block))
    if n_rows < tasks * block:  # few rows for those that ask: blocks small enough for all tasks
        of_rows = max(of_rows, min(-(-tasks // of_asking), -(-n_rows // LEAST)))
    asks, asked_as = packed(asking, of_asking)
    blocks, kind = packed(rows, of_rows)
    blocks = written(blocks.drop("no"), "vector_blocks").withColumnsRenamed({"part": "row_part", "ids": "row_ids", "vectors": "row_vectors"})
    blocks = blocks.coalesce(-(-tasks // of_asking))  # one part if those that ask are enough tasks
    pairs = blocks.hint("shuffle_replicate_nl").join(asks, F.col("part") == F.col("row_part")).select("no", "ids", "vectors", "row_ids", "row_vectors")
    best = pairs.mapInPandas(_nearest(k, asked_as, kind), "query_id long, vec_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return best.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)


def edges(vectors: DataFrame, k: int, least: float, within: str | None = None) -> DataFrame:
    """Rows ``(a, b, similarity)``, a < b: the undirected graph in which every vector is linked to its ``k`` nearest at ``least`` or more."""
    found = nearest(vectors, vectors, k, within).where(F.col("similarity") >= least)
    return found.groupBy(F.least("query_id", "vec_id").alias("a"), F.greatest("query_id", "vec_id").alias("b")).agg(F.max("similarity").alias("similarity"))
