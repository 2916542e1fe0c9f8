"""Collections in versions and results by content, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import matcher
from docspark.operators.collections import Cache, Collection, replace_uploads
from docspark.operators.tables import new_path
from docspark.plans import derived, findings
from docspark.plans.dialect import SPARK, frame, views
from docspark.sources import docx, files

KEYWORDS = {"critical": findings.CRITICAL_WORDS, "high": findings.HIGH_WORDS, "placeholder": findings.PLACEHOLDERS, "section": findings.SECTIONS, "facility": findings.FACILITIES, "vague": findings.VAGUE}
FILENAME = r"([^/?#]*)(?:[?#].*)?$"


@frame(lambda d: "SELECT d.doc_id, sha256(d.text) AS sha, len(list_filter(string_split(d.text, ' '), lambda w: w <> ''))::BIGINT AS n_words, h.text IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0) h ON d.text = h.text WHERE d.text IS NOT NULL")
def s29_cached_results(spark, sf_dir):
    """Words of all documents, by a cache of contents that the documents of even ids have gone through before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "text")
    cache = Cache(spark, new_path(spark, "cache"), "long")

    def count(df):
        return df.select("sha", F.size(F.filter(F.split("text", " "), lambda w: w != "")).cast("long").alias("result"))

    cache.through(docs.where("doc_id % 2 = 0"), "text", count)
    return cache.through(docs, "text", count).select("doc_id", "sha", F.col("result").alias("n_words"), "hit")


def _uploads(d) -> str:
    up = f"SELECT {d.extract('url', FILENAME, 1)} AS filename, page_id AS job, length(html) AS n_chars FROM pages"
    return f"SELECT filename, coalesce(max(CASE WHEN job % 2 = 1 THEN job END), max(job)) AS job, coalesce(arg_max(n_chars, CASE WHEN job % 2 = 1 THEN job END), arg_max(n_chars, job)) AS n_chars FROM ({up}) u GROUP BY filename"


@frame(_uploads)
def u12_replaced_uploads(spark, sf_dir):
    """Pages as uploads by file name, those of even ids first: one of the same name takes the place of the last and of its artifacts."""
    up = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract("url", FILENAME, 1).alias("filename"), F.col("page_id").alias("job"), F.length("html").cast("long").alias("n_chars"))
    base = new_path(spark, "uploads")
    uploads, artifacts = Collection(spark, f"{base}/uploads", "filename"), Collection(spark, f"{base}/artifacts", "job")
    for rest in (0, 1):
        new = up.where(F.col("job") % 2 == rest).groupBy("filename").agg(F.max("job").alias("job"))
        replace_uploads(uploads, artifacts, new, up.join(new.select("job"), "job", "left_semi").select("job", "n_chars"))
    return uploads.rows().join(artifacts.rows(), "job").select("filename", "job", "n_chars")


def _tables(d) -> str:
    has = ", ".join(f"CASE WHEN {findings.any_of(d, 'lower(text)', words)} THEN '{name}' END" for name, words in sorted(KEYWORDS.items()))
    return f"SELECT doc_id, array_to_string(list_filter([{has}], lambda x: x IS NOT NULL), ',') AS tables FROM documents"


@frame(_tables)
def p15_keyword_tables(spark, sf_dir):
    """Which of the keyword tables each document holds something of, in one pass over its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return matcher.tagged(docs, "text", {k: list(v) for k, v in KEYWORDS.items()}).select("doc_id", F.array_join("tables", ",").alias("tables"))


@frame(lambda d: "SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_paragraphs, text, CAST(NULL AS VARCHAR) AS error FROM documents")
def s6_docx_files(spark, sf_dir):
    """Documents written as Word files, a paragraph a line, and read back by the data source."""
    folder = new_path(spark, "docx")
    docx.write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder)
    rows = docx.load(spark, folder)
    sizes = rows.groupBy("path").agg(F.count("*").alias("n_paragraphs"))
    return docx.texts(rows).join(sizes, "path").select(F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long").alias("doc_id"), "n_paragraphs", "text", "error")


def _items(d) -> str:
    """What a document's report is made of, part by part: ids, pages where there are any, and digests of the texts."""
    parts = {
        "chunks": f"SELECT doc_id, chunk_id AS item_id, page, text FROM {derived.chunks(d)} c",
        "claims": f"SELECT doc_id, claim_id, NULL, text FROM {derived.claims(d)} c",
        "entities": f"SELECT doc_id, entity_id, NULL, concat(kind, ' ', text) FROM {derived.entities(d)} e",
        "ambiguities": f"SELECT doc_id, issue_id, page, concat(kind, ' ', quote) FROM {derived.ambiguities(d)} a",
        "findings": f"SELECT doc_id, finding_id, page, concat(title, ' ', explanation) FROM {derived.findings(d)} f",
        "objects": f"SELECT doc_id, knowledge_id, page, concat(section_path, ' ', text) FROM {derived.objects(d)} o",
        "elements": f"SELECT doc_id, {d.string('element_id')}, NULL, concat(kind, ' ', text) FROM {derived.elements(d)} e",
        "cells": f"SELECT doc_id, concat({d.string('table_id')}, '.', {d.string('row_no')}, '.', {d.string('col_no')}), NULL, text FROM {derived.cells(d)} c",
    }
    each = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS part, item_id, {d.int('page')} AS page, md5(text) AS digest FROM (SELECT * FROM ({sql}) AS x(doc_id, item_id, page, text)) p" for name, sql in parts.items())
    return f"SELECT doc_id, part, item_id, page, digest FROM ({each}) e WHERE doc_id IS NOT NULL"


@frame(lambda d: f"SELECT doc_id, part, count(*) AS n_items, CAST(to_json(list(struct_pack(item_id := item_id, page := page, digest := digest) ORDER BY item_id, page, digest)) AS VARCHAR) AS body FROM ({_items(d)}) i GROUP BY doc_id, part")
def s30_bundles(spark, sf_dir):
    """Each document's report as nested arrays, a row a part."""
    sql = _items(SPARK)
    views(spark, sf_dir, sql)
    return files.bundled(spark.sql(sql))
