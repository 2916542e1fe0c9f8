"""Spelling suggestions: symmetric deletes as join keys, verified by edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.tables import written

#: Letters that keys are made of. Words within two edits share a key however few these are; with few, many others share it too.
PREFIX = 12


def keyed(df: DataFrame, word: str, edits: int) -> DataFrame:
    """``df`` with ``key``: hashes of the prefix of ``word`` and of all it can become by deleting up to ``edits`` (1 or 2) letters.

    Positions are dealt out as rows: ``i`` and ``j`` are deleted, from 1; none if both are 0, one if they are equal. Words are
    few bytes and become many keys, so they are dealt over all cores first.
    """
    cols, spark = [F.col(c) for c in df.columns], df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pre = df.repartition(parts, word).select(*cols, F.substring(word, 1, PREFIX).alias("_w"))
    pre = pre.select(*cols, "_w", F.explode(F.sequence(F.lit(0), F.length("_w"))).alias("_i"))
    j = F.explode(F.sequence("_i", F.when(F.col("_i") > 0, F.length("_w")).otherwise(0))) if edits > 1 else F.col("_i")
    w, i, j_ = F.col("_w"), F.col("_i"), F.col("_j")
    left = F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, j_ - i - 1), F.substring(w, j_ + 1, F.lit(PREFIX)))
    return pre.select(*cols, "_w", "_i", j.alias("_j")).select(*cols, F.hash(left).alias("key"))


def _nearest(unknown: DataFrame, dictionary: DataFrame, edits: int) -> DataFrame:
    # the engine takes the keys for as few as the words, and would send them all through the driver
    near = keyed(unknown, "word", edits).join(keyed(dictionary, "term", edits).hint("merge"), "key").withColumn("distance", F.levenshtein("word", "term", edits)).where("distance >= 0")
    best = F.min_by(F.struct("term", "distance"), F.struct("distance", -F.col("freq"), "term")).alias("x")
    return near.groupBy("word").agg(best).select("word", F.col("x.term").alias("suggestion"), "x.distance")


def suggestions(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows ``(word, suggestion, distance)`` for ``words(word)`` not in ``dictionary(term, freq)``: the nearest term within two edits, then the most frequent, then by name.

    Only words without a term at one edit look for one at two, which takes many more keys.
    """
    unknown = written(words.select("word").distinct().join(dictionary, F.col("word") == F.col("term"), "left_anti"), "unknown_words")
    dictionary = dictionary.select("term", "freq")
    one = written(_nearest(unknown, dictionary, 1), "one_edit")
    return one.union(_nearest(unknown.join(one, "word", "left_anti"), dictionary, 2))
