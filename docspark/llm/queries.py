"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import collocations, decontam, htmldiff, iblt, langid, licences, linededup, mixing, quality, records, simhash, urlfilter, variants


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; they are installed beside the tokenizer libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(_table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identified(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.encoded(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmldiff.main_text(_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(_table(spark, sf_dir, "pages"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urlfilter.RULES, "rule string, verdict string")
    out = urlfilter.judged(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixing": op1_mixing, "op2_language": op2_language, "op3_token_records": op3_token_records, "op4_decontamination": op4_decontamination, "op5_main_text": op5_main_text, "op6_quality": op6_quality, "op7_line_dedup": op7_line_dedup, "op8_fingerprints": op8_fingerprints, "op9_simhash": op9_simhash, "op10_licences": op10_licences, "op11_spelling_variants": op11_spelling_variants, "op12_url_filter": op12_url_filter, "op13_collocations": op13_collocations}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": decontam.ORACLE, "op7_line_dedup": linededup.oracle(), "op10_licences": licences.oracle(), "op11_spelling_variants": variants.ORACLE, "op13_collocations": collocations.ORACLE}
