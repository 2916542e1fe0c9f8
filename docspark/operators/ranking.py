"""Places of all rows of a table in an order, without a single task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.tables import written


def places(df: DataFrame, name: str, *order: Column, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: each row's place in ``order``, from 1; the order should be total, else ties are in any order.

    Rows are dealt out by ranges of the order, numbered in their range, and moved on by the sizes of the ranges before. The
    driver holds one number for each range.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = written(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes, before, total = dict(ranges.groupBy("_range").count().collect()), {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    first = df.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_range int, _before long")
    w = Window.partitionBy("_range").orderBy(*order)
    out = ranges.withColumn("_place", F.row_number().over(w)).join(F.broadcast(first), "_range")
    return out.select(*df.columns, (F.col("_place") + F.col("_before")).cast("int").alias(name))
