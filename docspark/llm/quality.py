"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Features of a text. Words are runs without ASCII white space. There are two streams: the lower-cased words, and the
words' shapes (each run of capitals, small letters, digits or other marks is one symbol, with the length class of the
word and whether it is the word before once more). Each stream gives 1-grams and 2-grams, hashed into ``2**bits``
weights. A feature's value is its share of the text's n-grams of that kind, square-rooted, so length doesn't count.
A text without words (null, empty) has the bias feature alone.

Training uses labelled rows of one bounded sample (``rows``, documented here: about 12,000 rows, drawn by a hash of
doc_id; all of them where there are fewer) in hash order, on the driver, which gets their hashed features only. Scores
are sparse dot products over whole texts; labels, lang, source and doc_id are no features.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import release

BITS, ROWS, THRESHOLD = 18, 12_000, 0.3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_UP, _LOW, _NUM, _REST = re.compile(r"[A-Z]+"), re.compile(r"[a-zß-ÿ]+"), re.compile(r"\d+"), re.compile(r"[^AaN]+")


def shape(word: str) -> str:
    s = _NUM.sub("N", _LOW.sub("a", _UP.sub("A", word)))
    marks = "".join(dict.fromkeys("".join(_REST.findall(s))))[:3]
    return f"{_REST.sub('', s)[:4]}{marks}{min(len(word), 24) // 4}"


class Hasher:
    """Feature ids and values of texts; remembers words, within a bound."""

    def __init__(self, bits: int = BITS, most: int = 150_000):
        self.bits, self.most, self.known = bits, most, {}

    def _ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            a = zlib.crc32(w.lower().encode("utf-8", "replace"))
            b = zlib.crc32(shape(w).encode("utf-8", "replace"), 77)
            known[w] = (a << 32) | b
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        if not words:
            return np.zeros(1, np.int32), np.ones(1, np.float32)
        both = self._ids(words)
        ids, values = [np.zeros(1, np.int64)], [np.ones(1)]
        shift = np.uint64(64 - self.bits)
        for kind, h in enumerate((both >> np.uint64(32), both & np.uint64(0xFFFFFFFF))):
            again = np.zeros(len(h), np.uint64)
            if kind:  # a shape stream that knows repeated words
                w = both >> np.uint64(32)
                again[1:] = w[1:] == w[:-1]
            h = (h + again * np.uint64(7) + np.uint64(1 + kind)) * _MIX
            for grams in (h, (h[:-1] ^ (h[1:] >> np.uint64(13)) * _MIX) * _MIX + np.uint64(kind)):
                if len(grams):
                    found, count = np.unique((grams * _MIX) >> shift, return_counts=True)
                    ids.append(found.astype(np.int64))
                    values.append(np.sqrt(count / len(grams)))
        return np.concatenate(ids).astype(np.int32), np.concatenate(values).astype(np.float32)


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, ids=slice(None)) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, ids: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(ids)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        sigma = (np.sqrt(self.n[ids] + g * g) - np.sqrt(self.n[ids])) / self.alpha
        np.add.at(self.z, ids, g - sigma * w)
        np.add.at(self.n, ids, g * g)


def fold(doc_id, of: int):
    return F.crc32(doc_id.cast("string")) % of


def sample_ids(rows: DataFrame, bound: int) -> DataFrame:
    """Of ``rows(doc_id, ...)``, about ``bound`` in expectation, drawn by a hash of doc_id; all, if there are fewer."""
    n = rows.count()
    return rows if n <= bound else rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("draw")), F.lit(1 << 30)) < int(bound / n * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, bits: int = BITS, epochs: int = 3) -> np.ndarray:
    """Weights learned from ``labels(doc_id, quality)`` (null labels count for nothing); zeros if there is none."""
    wanted = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    wanted = sample_ids(wanted, rows)  # bounded, so it can be broadcast
    some = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = Hasher(bits)
        for pdf in batches:
            got = [h.features(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["quality"].astype(float), "ids": [a.tobytes() for a, _ in got], "x": [b.tobytes() for _, b in got]})

    got = some.mapInPandas(of, "doc_id long, y double, ids binary, x binary").toArrow()  # features stay in Arrow's memory
    doc_ids, ys = got["doc_id"].to_pylist(), got["y"].to_pylist()
    ids, xs = ([np.frombuffer(v.as_buffer(), kind) for v in got[c]] for c, kind in (("ids", np.int32), ("x", np.float32)))
    order = sorted(range(len(ys)), key=lambda k: (zlib.crc32(f"{doc_ids[k]}:order".encode()), doc_ids[k], zlib.crc32(ids[k])))
    model = Ftrl(bits)
    for _ in range(epochs):
        for k in order:
            model.update(ids[k], xs[k].astype(float), ys[k])
    return model.weights().astype(np.float32)


def _scores(spark: SparkSession, weights: np.ndarray):
    bits = int(len(weights)).bit_length() - 1
    sent = spark.sparkContext.broadcast(weights)  # of fixed size: 2**bits weights

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        h, w = Hasher(bits), sent.value
        for texts in parts:
            out = np.fromiter((float(w[a] @ b) for a, b in map(h.features, texts)), float, len(texts))
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))
        h = texts = None
        release()

    return of


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with ``score`` in 0 to 1, one row for each row; a null or empty text gets the bias's score.

    A column of ``docs`` that is called ``score`` gives way. Texts are scored whole, one at a time, however long they are.
    """
    return docs.withColumn("score", _scores(docs.sparkSession, weights)("text"))


def _learned(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> np.ndarray:
    return train(docs, labels.where(fold(F.col("doc_id"), folds) != held))


def classified(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; labels of the held-out fold aren't used.

    Rows whose doc_id is null are held out. Repeated rows get the same. Columns of ``docs`` with these names give way.
    """
    out = score(docs, _learned(docs, labels, folds, held)).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(True)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``classified`` predicts as good, with all their columns as they are, whatever their names."""
    return docs.where(_scores(docs.sparkSession, _learned(docs, labels, folds, held))("text") >= threshold)
