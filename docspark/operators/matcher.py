"""Many keyword tables in one pass over a text: an automaton of all keywords, which gives the tables, or keywords, that a text holds."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of all keywords together; tasks make the automaton of them.
MOST_BYTES = 256 << 20


def automaton(tables: dict[str, list[str]]):
    """Of all keywords, in small letters; each knows its tables."""
    of: dict[str, list[str]] = {}
    for name, words in tables.items():
        for w in words:
            if w:
                of.setdefault(w.lower(), []).append(name)
    a = ahocorasick.Automaton()
    for w, names in of.items():
        a.add_word(w, (w, tuple(sorted(set(names)))))
    if of:
        a.make_automaton()
    return a


def _found(tables: dict[str, list[str]], keywords: bool):
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = automaton(tables)
        for part in parts:
            out = []
            for text in part:
                hits = {x for _, x in a.iter(text.lower())} if text and len(a) else ()
                out.append(sorted({w for w, _ in hits}) if keywords else sorted({n for _, names in hits for n in names}))
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(of, "array<string>")


def tagged(df: DataFrame, text: str, tables: dict[str, list[str]], name: str = "tables", keywords: bool = False) -> DataFrame:
    """``df`` with ``name``: the names of ``tables`` of which ``text`` holds a keyword, sorted, or the keywords themselves.

    A keyword is held if it stands anywhere in the text, whatever the case. Null and empty texts hold none; empty keywords
    don't count. The work grows with the text and what it holds, not with the number of keywords.
    """
    size = sum(len(w) for words in tables.values() for w in words)
    if size > MOST_BYTES:
        raise ValueError("keyword tables of this size should be joined, not sent to all tasks")
    return df.withColumn(name, _found(tables, keywords)(text))
