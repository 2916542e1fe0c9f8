"""Readers and writers: text, JSON and CSV files, model-backed formats by adapter, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED = ("pdf", "docx", "txt")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder by path: path, extension, size, supported."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", ext.alias("extension"), F.col("length").alias("size"), ext.isin(*SUPPORTED).alias("supported"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """``.txt`` files as rows path, text; bytes that aren't UTF-8 become replacement marks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def adapted(spark: SparkSession, folder: str, pattern: str, read: Callable[[bytes], list[tuple[int, str]]]) -> DataFrame:
    """Files of another format by an adapter from bytes to (page, text) pairs: path, page, text."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path, page, text) for path, content in zip(pdf["path"], pdf["content"]) for page, text in read(bytes(content))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(of, "path string, page int, text string")


def dictionary(spark: SparkSession, path: str, common_above: int = 10_000_000) -> DataFrame:
    """A frequency dictionary of lines ``term frequency``: term, freq, is_common."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("term"), F.get(parts, F.lit(1)).try_cast("long").alias("freq"))
    return rows.where("freq is not null").withColumn("is_common", F.col("freq") > common_above)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def report_json(issues: DataFrame, by: str = "issue_type") -> DataFrame:
    """One row, one column: totals and all issues as JSON. For one document's report, not a corpus."""
    counts = issues.groupBy(by).count().agg(F.map_from_entries(F.collect_list(F.struct(by, "count"))).alias("by_type"))
    whole = issues.agg(F.count("*").alias("total_issues"), F.collect_list(F.struct(*issues.columns)).alias("issues"))
    return whole.crossJoin(counts).select(F.to_json(F.struct("total_issues", "by_type", "issues")).alias("report"))


def write_csv(issues: DataFrame, path: str) -> None:
    issues.write.mode("overwrite").option("header", "true").csv(path)


def bundled(items: DataFrame, by: str = "doc_id") -> DataFrame:
    """Rows ``(by, part, n_items, body)`` of ``items(by, part, item_id, …)``: each part's items as a JSON array, in the order of their columns from item_id on.

    The order is total but for equal items, so a bundle is the same at every run. A document's part must fit in a row; null keys are
    left out; items that are null aren't.
    """
    names = [c for c in items.columns if c not in (by, "part")]
    own = items.where(F.col(by).isNotNull() & F.col("part").isNotNull())
    lists = own.groupBy(by, "part").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("items"))
    return lists.select(by, "part", F.size("items").cast("long").alias("n_items"), F.to_json("items", {"ignoreNullFields": "false"}).alias("body"))


def write_bundle(bundles: DataFrame, folder: str, by: str = "doc_id") -> None:
    """A folder for each part, of lines ``{"by": …, "items": […]}``; parts that come again are replaced, the others stay."""
    line = F.concat(F.lit(f'{{"{by}":'), F.to_json(F.array(by)).substr(F.lit(2), F.length(F.to_json(F.array(by))) - 2), F.lit(',"items":'), "body", F.lit("}"))
    lines = bundles.select("part", line.alias("value")).repartition("part", F.pmod(F.xxhash64(by), F.lit(16))).sortWithinPartitions("part", "value")
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").text(folder)
