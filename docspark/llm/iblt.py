"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraph cells.

A text's pieces are its paragraphs (lines), cut further after sentence ends and, beyond 80 characters without one, every
80 characters. A piece's digest is its XXH64, with a number mixed in if the piece has come before in the text, so sketches
tell multisets apart. A sketch of m cells (three sub-tables, one cell of each for a digest) sums counts, digests and check
sums of digests, modulo 2**32 or 2**64. Subtracting two sketches leaves the digests of which one text has more; peeling
cells of count one recovers them. Where peeling gets stuck, both texts are sketched again with four times the cells.
A fingerprint string is the smallest sketch, as base64; equal texts have equal strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import by_size, release

CELLS, GROWTH, MOST_CELLS_AT_ONCE, LAST = 12, 4, 200_000, 64
#: Texts that are worked on together, by number and by characters.
ROWS_AT_ONCE, CHARS_AT_ONCE = 1024, 2_000_000
PIECE = re.compile(r"[^.!?\n]{1,80}[.!?\n]*|[.!?\n]+")
_LOWEST = -(2**63)


def digests(text: str) -> np.ndarray:
    """One distinct uint64 for each piece of ``text``."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, PIECE.findall(text)), np.uint64)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if not new.all():
        at = np.arange(len(s))
        nth = at - np.maximum.accumulate(np.where(new, at, 0))
        h[order] = s + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _check(x: np.ndarray) -> np.ndarray:
    return (_mix(x, 0x5EED) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class Sketches:
    """Sketches of many texts: arrays of shape (texts, cells)."""

    def __init__(self, n: int, m: int):
        self.n, self.m = n, m
        self.count, self.keys, self.checks = np.zeros(n * m, np.int32), np.zeros(n * m, np.uint64), np.zeros(n * m, np.uint32)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign) -> None:
        times = np.broadcast_to(np.asarray(sign, np.int32), keys.shape)
        many, checks = keys * times.astype(np.int64).view(np.uint64), _check(keys) * times.view(np.uint32)
        for j in range(3):
            at = self._cells(owner, keys, j)
            np.add.at(self.count, at, times)
            np.add.at(self.keys, at, many)
            np.add.at(self.checks, at, checks)

    def strings(self) -> list[str]:
        cell = np.zeros((self.n, self.m), [("c", "<i4"), ("k", "<u8"), ("s", "<u4")])
        for name, a in (("c", self.count), ("k", self.keys), ("s", self.checks)):
            cell[name] = a.reshape(self.n, self.m)
        return [base64.b64encode(row.tobytes()).decode() for row in cell]

    def _cells(self, owner: np.ndarray, keys: np.ndarray, j: int) -> np.ndarray:
        third = np.uint64(self.m // 3)
        return owner * self.m + (_mix(keys, j + 1) % third).astype(np.int64) + j * int(third)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovers digests until stuck: owner, digest, sign (1: only the first text has it); and which texts are done.

        A cell is peeled only if its check sum fits and its digest belongs to it. A text of which more than m digests
        come out is stuck, as m cells can't hold more: a cell that only looks pure ends so, and the text isn't done.
        """
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32))]
        out_of, stuck = np.zeros(self.n, np.int64), np.zeros(self.n, bool)
        while len(live := np.flatnonzero((np.abs(self.count) == 1) & ~np.repeat(stuck, self.m))):
            sign = self.count[live]
            keys = self.keys[live] * sign.astype(np.int64).view(np.uint64)
            pure = (self.checks[live] * sign.view(np.uint32)) == _check(keys)
            live, owner, keys, sign = live[pure], live[pure] // self.m, keys[pure], sign[pure]
            own = np.zeros(len(live), bool)
            for j in range(3):
                own |= self._cells(owner, keys, j) == live
            owner, keys, sign = owner[own], keys[own], sign[own]
            if not len(keys):
                break
            _, one = np.unique(np.stack([owner.astype(np.uint64), keys]), axis=1, return_index=True)
            owner, keys, sign = owner[one], keys[one], sign[one]
            found.append((owner, keys, sign))
            self.add(owner, keys, -sign)
            out_of += np.bincount(owner, minlength=self.n)
            stuck = out_of > self.m
        done = ~((self.count != 0) | (self.keys != 0) | (self.checks != 0)).reshape(self.n, self.m).any(axis=1) & ~stuck
        return (*(np.concatenate(x) for x in zip(*found)), done)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([*sets, np.zeros(0, np.uint64)])


def sketch(sets: list[np.ndarray], m: int = CELLS) -> Sketches:
    out = Sketches(len(sets), m)
    out.add(*_flat(sets), 1)
    return out


def differences(a: list[np.ndarray], b: list[np.ndarray], m: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets, what only the first and only the second has, by subtracting and peeling.

    Stuck pairs are sketched again with more cells; beyond LAST times as many cells as digests, which no pair of sets should
    need, the sets themselves are compared, so every pair ends.
    """
    out: list = [None] * len(a)
    size = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
    todo = np.arange(len(a))
    gap = np.array([abs(len(x) - len(y)) for x, y in zip(a, b)], np.int64)
    while len(todo):
        for k in todo[m > LAST * size[todo] + CELLS * GROWTH]:
            out[k] = (np.setdiff1d(a[k], b[k]), np.setdiff1d(b[k], a[k]))
        todo = todo[m <= LAST * size[todo] + CELLS * GROWTH]
        now, later = todo[gap[todo] <= m], [todo[gap[todo] > m]]  # that many can't be peeled from m cells
        step = max(1, MOST_CELLS_AT_ONCE // m)
        for i in range(0, len(now), step):
            some = now[i : i + step]
            s = sketch([a[k] for k in some], m)
            s.add(*_flat([b[k] for k in some]), -1)
            owner, keys, sign, done = s.peel()
            order = np.argsort(owner, kind="stable")
            owner, keys, sign = owner[order], keys[order], sign[order]
            cuts = np.searchsorted(owner, np.arange(len(some) + 1))
            for j, k in enumerate(some):
                if done[j]:
                    x, g = keys[cuts[j] : cuts[j + 1]], sign[cuts[j] : cuts[j + 1]]
                    out[k] = (x[g > 0], x[g < 0])
            later.append(some[~done])
        todo, m = np.concatenate(later), m * GROWTH
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """1 minus the share of pieces that differ; two texts without pieces are alike."""
    n = np.array([len(x) + len(y) for x, y in zip(a, b)], float)
    apart = np.array([len(x) + len(y) for x, y in differences(a, b)], float)
    return np.where(n > 0, 1 - apart / np.maximum(n, 1), 1.0)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(text: str) -> str:
    return sketch([digests(text)]).strings()[0]


def _rows(ids: list, texts: list[str]) -> pd.DataFrame:
    """All rows but the last, which is only the one that follows."""
    changed = [edited(t, n) for t, n in zip(texts, texts[1:])]
    own, other = [digests(t) for t in texts], [digests(t) for t in changed]
    return pd.DataFrame({
        "doc_id": pd.array(ids[:-1], dtype="Int64"), "n_chars": [len(t) for t in texts[:-1]], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": sketch(own[:-1]).strings(), "edited_fingerprint": sketch(other).strings(), "near_edited": likeness(own[:-1], other), "near_next": likeness(own[:-1], own[1:]),
    })


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _each_with_next(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by pid, edge, order; the first row with edge 1 is what follows the last of its pid."""
    held: tuple | None = None
    for pdf in batches:
        for i, j in zip((cuts := _cuts(pdf["text"])), cuts[1:]):
            part = pdf.iloc[i:j]
            rows = list(zip(part["pid"], part["edge"], part["doc_id"].astype("Int64"), part["text"].fillna("")))
            if held:
                rows = [held, *rows]
            held, k = rows[-1], 0
            while k < len(rows) - 1:  # a run: rows of one pid, and the first edge row
                j = k
                while j + 1 < len(rows) and rows[j][1] == 0 and rows[j + 1][0] == rows[j][0]:
                    j += 1
                if j > k:
                    yield _rows([r[2] for r in rows[k : j + 1]], [r[3] for r in rows[k : j + 1]])
                k = max(j, k + 1)
            release()


def _cuts(texts: pd.Series) -> list[int]:
    """Borders of runs of rows of at most ROWS_AT_ONCE rows and CHARS_AT_ONCE characters, or of one row."""
    cuts, chars = [0], 0
    for i, n in enumerate(texts.str.len().fillna(0).astype(int).tolist() if len(texts) else []):
        if i > cuts[-1] and (chars + n > CHARS_AT_ONCE or i - cuts[-1] == ROWS_AT_ONCE):
            cuts.append(i)
            chars = 0
        chars += n
    return [*cuts, len(texts)] if len(texts) else [0]


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``; see ``SCHEMA``. A null text is an empty one.

    The next document is that of the next doc_id (null first, ties by hash and text); after the last comes the first. So a
    single document is its own next one. Texts are dealt once, by ranges of doc_id that hold about equal sums of text (see
    ``by_size``); the first row of a range also goes to the range before. The driver holds the ranges' first rows' keys.
    """
    spark = docs.sparkSession
    key, tie = F.coalesce("doc_id", F.lit(_LOWEST)), F.xxhash64("text")
    pid, n, light = by_size(docs, key, F.octet_length("text"), tie, parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    firsts = light.groupBy(pid("key", "tie").alias("pid")).agg(F.min(F.struct("key", "tie")).alias("first"))
    firsts = sorted((r[0], r[1][0], r[1][1]) for r in firsts.collect())
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    # the first range's first row goes to the last; of rows alike in key and tie all go, of which one is used
    before = spark.sparkContext.broadcast({(k, t): firsts[i - 1][0] for i, (_, k, t) in enumerate(firsts)})

    @F.pandas_udf("int")
    def edge_of(keys: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(list(map(before.value.get, zip(keys.tolist(), ties.tolist()))), dtype="Int32")

    rows = docs.select("doc_id", "text", key.alias("key"), tie.alias("tie")).withColumn("own", pid("key", "tie")).withColumn("other", edge_of("key", "tie"))
    own = F.struct(F.col("own").alias("pid"), F.lit(0).alias("edge"))
    to = F.when(F.col("other").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("other").alias("pid"), F.lit(1).alias("edge"))))
    rows = rows.select(F.explode(to).alias("to"), "doc_id", "text", "key", "tie").select("to.pid", "to.edge", "doc_id", "text", "key", "tie")
    dealt = rows.repartitionById(n, F.col("pid")).sortWithinPartitions("pid", "edge", "key", "tie").select("pid", "edge", "doc_id", "text")
    return dealt.mapInPandas(_each_with_next, SCHEMA)
