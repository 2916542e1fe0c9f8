"""Benchmark decontamination: which documents hold which short test items.

Words are lower-cased runs of letters and digits; shingles are five words in a row (an item of fewer words is one shingle
of all its words, and is looked for as such; one without words is never found). An item of q distinct shingles is in a
document if the document has at least ``ceil(threshold * q)`` of them.

Search. Items are partitioned by size (q within a power of two); a partition's sketches are the items' m smallest
shingle hashes, m = floor((1 - threshold) * upper size) + 1: a bottom-m MinHash. A document that holds enough of an
item misses at most m - 1 of its shingles, so it has one of the m. That bound makes the search whole; bands of a
Jaccard signature cannot give that, as a 20-word item in a long document has a likeness near 0. Candidates are
verified by the exact share of their shingles, compared as words, not as hashes. All of it is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import once, written

WIDTH, THRESHOLD = 5, 0.8
#: Sketches and candidates are broadcast up to so many bytes; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def _small(df: DataFrame, size=40) -> DataFrame:
    """A written table with the hint that fits its summed size; ``size``: bytes of a row, a number or a column."""
    return F.broadcast(df) if (df.agg(F.sum(F.lit(size))).first()[0] or 0) <= BROADCAST_BYTES else df.hint("merge")


def words(text: F.Column) -> F.Column:
    """Lower-cased runs of letters and digits; of a null text none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(w: F.Column, width) -> F.Column:
    return F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))


def _hashes(w: F.Column, width: int) -> F.Column:
    return F.transform(_starts(w, width), lambda i: F.xxhash64(F.lit(width), *[F.get(w, i + k) for k in range(width)]))


def _shingles(w: F.Column, width) -> F.Column:
    return F.array_distinct(F.transform(_starts(w, width), lambda i: F.array_join(F.slice(w, i + 1, width), " ")))


def sketches(items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``items(item_id, text)`` as item_id, row (a hash that names the item), width, shingles (distinct, sorted), need, keys (the sketch)."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("width", F.least(F.size("w"), F.lit(width)))
    hashes = F.lit(None)
    for n in range(1, width + 1):
        hashes = F.when(F.col("width") == n, _hashes(F.col("w"), n)).otherwise(hashes)
    out = w.select("item_id", "width", F.array_sort(_shingles(F.col("w"), F.col("width"))).alias("shingles"), F.array_sort(F.array_distinct(hashes)).alias("h"))
    q = F.size("shingles")
    upper = F.pow(F.lit(2), F.ceil(F.log2(q)))  # the size partition
    m = F.least(q, F.floor((1 - threshold) * upper + 1e-9) + 1).cast("int")
    row = F.xxhash64("item_id", F.array_join("shingles", " "))
    return out.select("item_id", row.alias("row"), "width", "shingles", F.ceil(q * threshold - 1e-9).cast("int").alias("need"), F.slice("h", 1, m).alias("keys"))


def _candidates(docs: DataFrame, ready: DataFrame) -> DataFrame:
    """Rows ``(_doc, _tkey, _rows)``: for each doc_id and text's hash the items that have a sketch hash in it."""
    widths = sorted(r[0] for r in ready.select("width").distinct().collect())  # five at most
    keys = _small(ready.select("row", "width", F.explode("keys").alias("key")))
    own = once(docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_tkey"), "text"), "w", words(F.col("text"))).drop("text")
    found = [own.select("_doc", "_tkey", F.explode(_hashes(F.col("w"), n)).alias("key")).join(keys.where(F.col("width") == n), "key").select("_doc", "_tkey", "row") for n in widths]
    pairs = found[0] if found else own.select("_doc", "_tkey", F.lit(None).cast("long").alias("row")).where("false")
    for more in found[1:]:
        pairs = pairs.union(more)
    return written(pairs.groupBy("_doc", "_tkey").agg(F.collect_set("row").alias("_rows")), "candidates")


def _verified(docs: DataFrame, items: DataFrame, threshold: float, width: int) -> DataFrame:
    """Rows ``(doc_id, _tkey, item_id, n, q)`` for each row of ``docs`` and item that its whole text holds."""
    ready = written(sketches(items, threshold, width), "sketches")
    on = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_tkey"))
    pairs = docs.select("doc_id", "text").join(_small(_candidates(docs, ready), 40 + 8 * F.size("_rows")), on).select("doc_id", "_tkey", "text", "_rows")
    pairs = once(pairs, "_w", words(F.col("text"))).select("doc_id", "_tkey", "_w", F.explode("_rows").alias("row"))
    pairs = pairs.join(_small(ready.select("item_id", "row", "width", "shingles", "need"), 60 + F.octet_length(F.array_join("shingles", "     "))), "row")
    pairs = once(pairs, "n", F.size(F.array_intersect(_shingles(F.col("_w"), F.col("width")), F.col("shingles"))))
    return pairs.where("n >= need").select("doc_id", "_tkey", "item_id", "n", F.size("shingles").alias("q"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """Rows ``(doc_id, item_id, n_shared, n_item, containment)`` for each row of ``docs(doc_id, text)`` and item it holds.

    Null or empty texts and items hold and match nothing. Repeated rows of ``docs`` give repeated rows; items that share
    an item_id each count. Empty tables give no rows. Texts of any length are searched whole.
    """
    found = _verified(docs, items, threshold, width)
    return found.select("doc_id", "item_id", F.col("n").alias("n_shared"), F.col("q").alias("n_item"), (F.col("n") / F.col("q")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``docs`` without the rows that hold any item; all columns stay, whatever their names. See ``contaminated``."""
    found = _verified(docs, items, threshold, width).select(F.col("doc_id").alias("_doc"), "_tkey").distinct()
    on = F.expr("own.doc_id <=> found._doc AND xxhash64(own.text) = found._tkey")
    return docs.alias("own").join(_small(written(found, "contaminated")).alias("found"), on, "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, row_number() OVER () AS iid, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT item_id, iid, least(len(w), 5) AS width, unnest(list_distinct(list_transform(range(0, len(w) - least(len(w), 5) + 1), lambda k: array_to_string(w[k + 1:k + least(len(w), 5)], ' ')))) AS sh FROM i WHERE len(w) > 0),
q AS (SELECT item_id, iid, width, count(*) AS n_item FROM s GROUP BY ALL),
ds AS (SELECT DISTINCT rid, doc_id, width, unnest(list_transform(range(0, len(w) - width + 1), lambda k: array_to_string(w[k + 1:k + width], ' '))) AS sh
       FROM d, (SELECT DISTINCT width FROM q) WHERE len(w) >= width),
m AS (SELECT ds.doc_id, ds.rid, s.item_id, s.iid, count(*) AS n_shared FROM ds JOIN s ON ds.sh = s.sh AND ds.width = s.width GROUP BY ALL)
SELECT m.doc_id, m.item_id, CAST(n_shared AS INTEGER) AS n_shared, CAST(n_item AS INTEGER) AS n_item, n_shared / n_item AS containment
FROM m JOIN q USING (iid) WHERE n_shared >= ceil(n_item * 0.8 - 1e-9)
"""
