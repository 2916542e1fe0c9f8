"""Paragraphs of a text and elements of its layout, paired in order by what they begin with."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = 30


def pairs(paragraphs: list[str], elements: list[str]) -> list[int]:
    """For each paragraph the place of its element: the next one not passed yet of which one's first characters are in the other.

    Elements that don't fit are passed for good; when none is left, paragraphs get the last one. Without elements: -1.
    """
    left = iter(enumerate(elements))
    fits = lambda p, e: bool(e) and (p[:PREFIX] in e or e[:PREFIX] in p)
    return [next((k for k, e in left if fits(p, e)), len(elements) - 1) for p in paragraphs]


def align(paragraphs: DataFrame, elements: DataFrame) -> DataFrame:
    """Rows ``(doc_id, paragraph_id, element_id)`` from ``paragraphs(doc_id, paragraph_id, text)`` and ``elements(doc_id, element_id, text)``.

    Both are taken in the order of their ids; a document fits in a task. Null texts are empty ones, which fit nothing;
    paragraphs of a document without elements have a null element.
    """

    def of(p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        p, e = p.sort_values("paragraph_id", kind="stable"), e.sort_values("element_id", kind="stable")
        text = lambda x: x["text"].fillna("").str.strip().tolist()
        ids = e["element_id"].tolist()
        found = [ids[k] if k >= 0 else None for k in pairs(text(p), text(e))]
        return pd.DataFrame({"doc_id": p["doc_id"], "paragraph_id": p["paragraph_id"], "element_id": pd.array(found, dtype="Int64")})

    elements = elements.select(F.col("doc_id").alias("_doc"), F.col("element_id").cast("long").alias("element_id"), "text")
    paragraphs = paragraphs.select("doc_id", F.col("paragraph_id").cast("long").alias("paragraph_id"), "text")
    return paragraphs.groupBy("doc_id").cogroup(elements.groupBy("_doc")).applyInPandas(of, "doc_id long, paragraph_id long, element_id long")
