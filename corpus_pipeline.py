"""Documents to a token file: quality, near-duplicates, decontamination, mix, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import decontam, mixing, quality, records, simhash
from docspark.llm.queries import vocabulary
from docspark.operators.tables import forget, mark, new_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; trained on the labels that aren't held out.

    Null and empty texts get the score of the bias. Repeated rows are judged alike. Columns that the classifier itself
    adds don't touch those of ``docs``; an empty table stays empty.
    """
    return quality.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id; repeated rows and empty texts are copies too."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``; null and empty texts hold none."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of words, mixed by source: doc_id is a block's place in the mix (see ``mixing.mixed_documents``)."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of the blocks, in the order of the mix; the row of each, read back from the files."""
    return records.encoded(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("token records", encode),
]
#: Learning, components and tokenizers can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written as Parquet and read again as the next stage's input.

    What a stage has written on its way is deleted when its result is stored.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path, since = new_path(spark, f"stage-{i}"), mark()
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            forget(spark, since)
    return docs
