"""Order-dependent selections: token budgets and batches. What an item gets depends on all items before it, so a group is one loop."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fold(items: DataFrame, group: str, order: str, size: str, step, name: str, kind: str) -> DataFrame:
    types = dict(items.dtypes)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        state, out = None, []
        for n in pdf[size].tolist():
            state, x = step(state, n)
            out.append(x)
        return pdf[[group, order]].assign(**{name: out})

    return items.select(group, order, size).groupBy(group).applyInPandas(of, f"`{group}` {types[group]}, `{order}` {types[order]}, `{name}` {kind}")


def within_budget(items: DataFrame, group: str, order: str, tokens: str, budget: int, each: int = 50) -> DataFrame:
    """Greedy choice in order: an item is ``taken`` if it still fits with ``each`` tokens on top, which count too, else skipped.

    A group (one question's context) must fit in a task; rows with a null group are a group.
    """

    def step(used, n):
        fits = (used or 0) + n + each <= budget
        return (used or 0) + (n + each) * fits, bool(fits)

    return _fold(items, group, order, tokens, step, "taken", "boolean")


def batches(items: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """``batch`` numbers: a batch is closed when the next item would overflow it; an item above the budget is alone."""

    def step(state, n):
        used, batch = state or (0, 0)
        over = used > 0 and used + n > budget
        state = (n, batch + 1) if over else (used + n, batch)
        return state, state[1]

    return _fold(items, group, order, size, step, "batch", "int")


def _estimate(words: int) -> int:
    return int(words * 1.3) + 1


def tokens(text: str) -> int:
    return _estimate(len(text.split()))


def tail(text: str, budget: int = 50) -> str:
    """The last sentences of a text, of up to ``budget`` tokens, at least one; of a text without sentence ends its last words."""
    sentences = re.split(r"(?<=[.!?])\s+", text)
    if len(sentences) < 2:
        words = text.split()
        return text if len(words) <= budget else " ".join(words[-budget:])
    n = used = 0
    for s in reversed(sentences):
        if (used := used + tokens(s)) > budget:
            break
        n += 1
    return " ".join(sentences[-max(n, 1) :])


def split_text(text: str, budget: int = 500) -> list[str]:
    """A text in parts of up to ``budget`` tokens: at sentence ends, else at commas and semicolons, else at words.

    A sentence or clause above the budget is a part of its own. An empty text has no parts.
    """
    if tokens(text) <= budget:
        return [text] if text else []
    units = next((u for p in (r"(?<=[.!?])\s+", r"(?<=[,;])\s+") if len(u := re.split(p, text)) > 1), None)
    if units is None:
        words, most = text.split(), 1
        while int(most * 1.3) + 1 < budget:
            most += 1
        return [" ".join(words[i : i + most]) for i in range(0, len(words), most)]
    out, used = [[]], 0
    for u in units:
        if out[-1] and used + tokens(u) > budget:
            out, used = [*out, []], 0
        out[-1].append(u)
        used += tokens(u)
    return [" ".join(p) for p in out if p]


def split_parts(parts: DataFrame, budget: int = 500) -> DataFrame:
    """Rows ``(doc_id, ord, part, text)`` from ``parts(doc_id, ord, text)``: ``split_text`` of each; null texts have no parts."""

    def of(batches):
        for pdf in batches:
            rows = [(d, o, i, p) for d, o, t in zip(pdf["doc_id"], pdf["ord"], pdf["text"]) for i, p in enumerate(split_text(t or "", budget))]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "part", "text"])

    return parts.select("doc_id", "ord", "text").mapInPandas(of, "doc_id long, ord long, part int, text string")


def _packed(rows: Iterable[tuple], budget: int, overlap: int) -> Iterator[tuple]:
    """Chunks ``(doc_id, chunk_no, kind, text, tokens)`` of rows ``(doc_id, kind, text)``, which come document by document, in order.

    Words of joined texts are the sum of their words, so each text is counted once.
    """
    doc, kind, no = object(), None, 0  # no document yet
    held, n = [], 0  # n: words that are held
    for d, k, text in rows:
        text = text or ""
        words = len(text.split())
        if d != doc or k != kind or kind == "heading":
            if held:
                yield doc, no, kind, "\n".join(held), _estimate(n)
            no = no + 1 if d == doc else 0
            doc, kind, held, n = d, k, [], 0
        elif _estimate(n + words) > budget:
            last = "\n".join(held)
            yield doc, no, kind, last, _estimate(n)
            t = tail(last, overlap)
            no, held, n = no + 1, [t] if t else [], len(t.split())
        held.append(text)
        n += words
    if held:
        yield doc, no, kind, "\n".join(held), _estimate(n)


def chunks(parts: DataFrame, budget: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of a document from ``parts(doc_id, ord, kind, text)``, in order.

    A chunk is closed at ``budget`` tokens (words x 1.3), where the kind changes, and at a heading, which is its own chunk. After a
    full chunk the next one begins with its ``tail``. Rows come sorted to a task, which holds a batch of them and one chunk.
    """
    types = {"doc_id": pa.int64(), "chunk_no": pa.int32(), "kind": pa.string(), "text": pa.string(), "tokens": pa.int32()}

    def of(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "kind", "text"))))
        made = _packed(rows, budget, overlap)
        while some := list(itertools.islice(made, 256)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types.values())], list(types))

    ordered = parts.repartition("doc_id").sortWithinPartitions("doc_id", F.asc_nulls_last("ord"))
    return ordered.select("doc_id", "kind", "text").mapInArrow(of, "doc_id long, chunk_no int, kind string, text string, tokens int")
