"""Spans of texts found by patterns, with offsets, in one pass over the documents; and texts with spans replaced."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks that no text holds stand before and behind a match.
OPEN, SHUT = chr(1), chr(2)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _starts(sizes: pd.Series) -> pd.Series:
    """For each row's sizes the sums of those before, all rows of a batch at once."""
    if not len(sizes):
        return pd.Series([], dtype=object)
    n = np.fromiter(map(len, sizes), np.int64, len(sizes))
    flat = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(sizes.to_list()).astype(np.int64))])
    ends = np.cumsum(n)
    return pd.Series([(flat[e - k : e] - flat[e - k]).astype(np.int32) for k, e in zip(n.tolist(), ends.tolist())], dtype=object)


def found(docs: DataFrame, patterns: dict[str, str], text: str = "text", key: str = "doc_id", cues: dict[str, str] | None = None) -> DataFrame:
    """Matches of all ``patterns`` in ``docs``: rows ``(doc_id, pattern, char_start, char_end, text)``, in linear time.

    ``cues`` are cheap patterns that a text with a match of the pattern of that name always has; other texts aren't looked through.
    Texts are split once for each pattern. Offsets are sums of the pieces' lengths, of which only the numbers leave the row, so
    pieces are neither dealt out nor sorted; the first piece, which has no match, isn't even a row. A null text has no match.
    """
    pieces = lambda p: F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"({p})", f"{OPEN}$1{SHUT}"), OPEN, -1)
    asked = lambda name: F.when(F.col(text).rlike(cues[name]), pieces(patterns[name])) if cues and name in cues else pieces(patterns[name])
    sets = F.array(*[F.struct(F.lit(name).alias("pattern"), asked(name).alias("pieces")) for name in patterns])
    each = docs.select(F.col(key).alias("doc_id"), F.explode(sets).alias("s")).select("doc_id", "s.pattern", "s.pieces").where("size(pieces) > 1")
    # of a piece with a match, the mark behind it doesn't count
    sizes = F.transform("pieces", lambda x, i: F.length(x) - (i > 0).cast("int"))
    each = each.select("doc_id", "pattern", F.explode(F.slice(F.arrays_zip("pieces", _starts(sizes).alias("starts")), 2, 2**31 - 1)).alias("m"))
    each = each.select("doc_id", "pattern", F.col("m.starts").cast("long").alias("char_start"), F.substring_index("m.pieces", SHUT, 1).alias("text"))
    return each.select("doc_id", "pattern", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"), "text")


def replaced(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows ``(doc_id, text)``: texts of ``docs`` with ``spans(doc_id, char_start, char_end, put)``, which don't overlap, replaced.

    A document's spans come to its text as one list, so a text is moved once, however many spans it has.
    """
    lists = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "put"))).alias("spans"))
    out = docs.select("doc_id", "text").join(lists, "doc_id", "left")
    cut = lambda a, b: F.substring("text", a.cast("int") + 1, (b - a).cast("int"))

    def part(s: Column, i: Column) -> Column:
        before = F.coalesce(F.get("spans", i - 1)["char_end"], F.lit(0))
        return F.concat(cut(before, s["char_start"]), s["put"])

    tail = F.substring("text", F.element_at("spans", -1)["char_end"].cast("int") + 1, F.length("text"))
    whole = F.concat(F.array_join(F.transform("spans", part), ""), tail)
    return out.select("doc_id", F.when(F.col("spans").isNull(), F.coalesce("text", F.lit(""))).otherwise(whole).alias("text"))
