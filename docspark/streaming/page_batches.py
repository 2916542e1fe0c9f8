"""Resumable ingest of pages in batches: each round of batches is committed at once, and a run goes on where the last one stopped.

A document's pages are dealt in batches of consecutive pages, batches in rounds by hash. A round is written aside and renamed when
it is whole, so what is there is committed and what isn't will be done again; a run that is killed leaves no half round. How pages
are dealt is in a manifest that the first run writes, so later runs deal them alike. Pages that the parser fails on are skipped and
told, and don't stop their batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.operators.tables import delete, exists

ROUND = "doc_id long, batch int, local_page int, local_no int, text string, error string"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifest(spark: SparkSession, folder: str, wanted: dict) -> dict:
    """The manifest of the folder; the first to come writes it."""
    path = f"{folder}/manifest.json"
    fs, p = _fs(spark, path)
    if not exists(spark, path):
        aside = f"{folder}/.manifest-{uuid.uuid4().hex}"
        out = fs.create(_fs(spark, aside)[1])
        out.write(bytearray(json.dumps(wanted).encode()))
        out.close()
        fs.rename(_fs(spark, aside)[1], p)
    return json.loads("".join(r.value for r in spark.read.text(path).collect()))


def _parsed(pages: DataFrame, parse: Callable[[str], list[str]]) -> DataFrame:
    """``pages`` with ``parts``, what ``parse`` makes of ``content``, and ``error`` where it fails; a null content has no parts."""

    @F.pandas_udf("parts array<string>, error string")
    def of(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in contents:
            rows = []
            for content in part:
                try:
                    rows.append(([] if content is None else list(parse(content)), None))
                except Exception as e:
                    rows.append(([], str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["parts", "error"])

    return pages.withColumn("_p", of("content")).select("*", "_p.parts", "_p.error").drop("_p")


def ingest(pages: DataFrame, parse: Callable[[str], list[str]], folder: str, batch_pages: int = 15, rounds: int = 8, most: int | None = None) -> int:
    """Does the rounds of ``pages(doc_id, page, content)``, page from 1, that ``folder`` lacks, ``most`` of them at most; how many are left.

    Rows without a doc_id or page are left out; of repeated pages each is parsed. Batches are numbered from 0 in a document.
    """
    spark = pages.sparkSession
    m = _manifest(spark, folder, {"batch_pages": batch_pages, "rounds": rounds})
    batch = F.floor((F.col("page") - 1) / m["batch_pages"]).cast("int")
    dealt = pages.where("doc_id is not null and page >= 1").select("doc_id", "page", "content", batch.alias("batch"))
    dealt = dealt.withColumn("round", F.pmod(F.xxhash64("doc_id", "batch"), F.lit(m["rounds"])).cast("int"))
    fs, done = _fs(spark, folder)[0], 0
    missing = [r for r in range(m["rounds"]) if not exists(spark, f"{folder}/round-{r:05}")]
    for r in missing[:most]:
        own = _parsed(dealt.where(F.col("round") == r), parse)
        items = own.select("doc_id", "batch", "page", "error", F.posexplode_outer("parts").alias("pos", "text")).where("text is not null or error is not null")
        order = Window.partitionBy("doc_id", "batch").orderBy("page", "pos", "text")
        no = F.when(F.col("error").isNull(), F.sum(F.col("error").isNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        rows = items.select("doc_id", "batch", (F.col("page") - F.col("batch") * m["batch_pages"]).cast("int").alias("local_page"), no.cast("int").alias("local_no"), "text", "error")
        aside = f"{folder}/.aside-{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        if not fs.rename(_fs(spark, aside)[1], _fs(spark, f"{folder}/round-{r:05}")[1]):
            raise OSError(f"round {r} could not be committed")
        done += 1
    return len(missing) - done


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """Rows ``(doc_id, element_id, page, text, error)`` of all committed rounds: ids begin with their batch, pages are the document's.

    A skipped page is a row of its error alone.
    """
    m = _manifest(spark, folder, {"batch_pages": 1, "rounds": 0})
    paths = [p for r in range(m["rounds"]) if exists(spark, p := f"{folder}/round-{r:05}")]
    rows = spark.read.schema(ROUND).parquet(*paths) if paths else spark.createDataFrame([], ROUND)
    element = F.concat(F.lit("b"), "batch", F.lit("_"), "local_no")
    return rows.select("doc_id", element.alias("element_id"), (F.col("local_page") + F.col("batch") * m["batch_pages"]).cast("int").alias("page"), "text", "error")


def finish(spark: SparkSession, folder: str, target: str) -> None:
    """When all rounds are there: the merged rows at ``target``, and the rounds go."""
    m = _manifest(spark, folder, {"batch_pages": 1, "rounds": 0})
    if any(not exists(spark, f"{folder}/round-{r:05}") for r in range(m["rounds"])):
        raise ValueError("rounds are missing")
    merged(spark, folder).write.parquet(target)
    delete(spark, folder)
