"""Layout: blocks, paragraphs and sentences of documents with their offsets."""

from __future__ import annotations

from docspark.plans.dialect import frame, plan, rows
from docspark.plans.text import PAGE_NUMBER, lines, no_links, strip_markdown

# The patterns of the block rules, in the order in which they are tried.
REFERENCES = r"(?i)^\s*(references|bibliography|works cited)\s*$"
TABLE_ROW = r"^\s*\|.*\|\s*$|^(\s*\S+\s*\|){2,}"
CAPTION = r"(?i)^\s*(table|figure|fig\.?)\s+\d+"
REFERENCE_ENTRY = r"^\s*(\[\d+\]|\d+\.)\s+.+\(\d{4}\)|^\s*[A-Z][a-zA-Z]+,\s*[A-Z]\.[^.]*\(\d{4}\)"
HEADER = r"(?i)^(confidential|draft|copyright|all rights reserved)\b"
HEADING = r"^\s{0,3}(#{1,6}\s+.+|[A-Z][A-Za-z0-9 \-:]{2,80})$"
NUMBERED = r"^\s{0,3}\d+(\.\d+)*\s+[A-Z].{0,80}$"


def blocks(d) -> str:
    """One row for each line that isn't blank: doc_id, block_id, text; ids run from 0 in document order."""
    return f"SELECT doc_id, {d.int('row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1')} AS block_id, trim(line) AS text FROM documents {d.each(lines(d), 'line', 'pos')} WHERE trim(line) <> ''"


def classified(d) -> str:
    seen = f"max(CASE WHEN {d.like('text', REFERENCES)} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    kind = f"""CASE WHEN {d.like('text', PAGE_NUMBER)} THEN 'page_number' WHEN {d.like('text', REFERENCES)} THEN 'reference' WHEN in_references = 1 THEN 'reference'
    WHEN {d.like('text', TABLE_ROW)} THEN 'table' WHEN {d.like('text', CAPTION)} THEN 'caption' WHEN {d.like('text', REFERENCE_ENTRY)} THEN 'reference' WHEN {d.like('text', HEADER)} THEN 'header'
    WHEN {d.like('text', HEADING)} AND length(text) < 90 AND text NOT LIKE '%.' THEN 'heading' WHEN {d.like('text', NUMBERED)} AND length(text) < 90 THEN 'heading'
    WHEN length(text) < 5 THEN 'footer' ELSE 'paragraph' END"""
    return f"SELECT doc_id, block_id, text, {kind} AS block_type FROM (SELECT *, {seen} AS in_references FROM ({blocks(d)}) b) c"


def paragraphs(d) -> str:
    """Lines as paragraphs, trimmed, with their offsets in the text."""
    start = "coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    inner = f"SELECT doc_id, pos, line, {start} + length(line) - length(ltrim(line)) AS char_start FROM documents {d.each(lines(d), 'line', 'pos')}"
    return f"SELECT doc_id, {d.int('row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1')} AS paragraph_id, trim(line) AS text, {d.long('char_start')} AS char_start, {d.long('char_start + length(trim(line))')} AS char_end FROM ({inner}) p WHERE trim(line) <> ''"


def sentences(d) -> str:
    """Sentences of paragraphs: cut where white space follows . ! or ? and a capital or a quote comes next."""
    mark = chr(1)
    if d.__class__.__name__ == "DuckSql":
        cut = d.sub("text", r"""([.!?]\s+)([A-Z"'“])""", d.group(1) + mark + d.group(2))
    else:
        cut = d.sub("text", r"""([.!?]\s+)(?=[A-Z"'“])""", d.group(1) + mark)
    start = "char_start + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, paragraph_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    inner = f"SELECT doc_id, paragraph_id, pos, rtrim(piece) AS text, {d.long(start)} AS char_start FROM ({paragraphs(d)}) p {d.each(d.split(cut, mark), 'piece', 'pos')}"
    return f"SELECT doc_id, paragraph_id, {d.int('row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_id, pos) - 1')} AS sentence_id, text, char_start, char_start + length(text) AS char_end FROM ({inner}) s WHERE text <> ''"


@plan
def f5_blocks(d):
    return blocks(d)


@plan
def p1_block_types(d):
    return f"SELECT doc_id, block_id, block_type FROM ({classified(d)}) c"


@plan
def a1_block_type_counts(d):
    return f"SELECT block_type, count(*) AS n FROM ({classified(d)}) c GROUP BY block_type"


@plan
def p2_block_filter(d):
    clean = f"trim({no_links(d, strip_markdown(d, 'text'))})"
    return f"SELECT doc_id, block_id, clean FROM (SELECT doc_id, block_id, {clean} AS clean FROM ({classified(d)}) c WHERE block_type IN ('paragraph', 'heading')) f WHERE clean <> ''"


@plan
def a2_reviewable_share(d):
    return f"SELECT doc_id, sum(CASE WHEN block_type IN ('paragraph', 'heading') THEN length(text) ELSE 0 END) / sum(length(text)) AS ratio, {d.long("count_if(block_type IN ('paragraph', 'heading'))")} AS proof_blocks FROM ({classified(d)}) c GROUP BY doc_id"


@plan
def p3_image_dominated(d):
    inner = f"SELECT doc_id, sum(CASE WHEN block_type IN ('paragraph', 'heading') THEN length(text) ELSE 0 END) / sum(length(text)) AS ratio, count_if(block_type IN ('paragraph', 'heading')) AS proof FROM ({classified(d)}) c GROUP BY doc_id"
    return f"SELECT doc_id FROM ({inner}) r WHERE ratio < 0.15 AND proof < 2"


@plan
def f6_paragraphs(d):
    return paragraphs(d)


@plan
def w3_offsets_hold(d):
    """Every paragraph is found again at its offsets."""
    return f"SELECT p.doc_id, count(*) AS n, {d.long('count_if(substr(t.text, CAST(p.char_start AS INT) + 1, CAST(p.char_end - p.char_start AS INT)) = p.text)')} AS n_ok FROM ({paragraphs(d)}) p JOIN documents t ON p.doc_id = t.doc_id GROUP BY p.doc_id"


@plan
def f7_sentences(d):
    return sentences(d)


@plan
def p4_reviewable_paragraphs(d):
    """Paragraphs of 25 characters or more with 15 words or more, or with a candidate inside."""
    n = d.size(d.keep(d.split("text", r"\s+"), "w", "w <> ''"))
    from docspark.plans.spans import bucketed, candidates

    flagged = f"SELECT DISTINCT p.doc_id, p.paragraph_id FROM ({bucketed(d, paragraphs(d))}) p JOIN (SELECT doc_id, char_start, floor(char_start / 64) AS bucket FROM ({candidates(d)}) x) c ON p.doc_id = c.doc_id AND p.bucket = c.bucket AND c.char_start >= p.char_start AND c.char_start < p.char_end"
    return f"SELECT p.doc_id, p.paragraph_id FROM ({paragraphs(d)}) p LEFT JOIN ({flagged}) f ON p.doc_id = f.doc_id AND p.paragraph_id = f.paragraph_id WHERE length(text) >= 25 AND ({n} >= 15 OR f.doc_id IS NOT NULL)"


@plan
def p10_semantic_content(d):
    return f"SELECT doc_id, block_id, NOT {d.like('text', r'^[-*•\s]*$|^[=_\-*~]{3,}$')} AS has_content FROM ({blocks(d)}) b"


@plan
def w1_running_ids(d):
    return f"SELECT doc_id, count(*) AS n_sentences, max(sentence_id) AS last_sentence, max(paragraph_id) AS last_paragraph FROM ({sentences(d)}) s GROUP BY doc_id"


@plan
def s8_document_profile(d):
    return f"SELECT doc_id, {d.int('ceil(length(text) / 2000)')} AS pages, CASE WHEN length(text) / ceil(greatest(length(text), 1) / 2000) > 100 THEN 'digital' ELSE 'scanned' END AS kind, {d.size(d.keep(lines(d), 'l', d.like('l', TABLE_ROW)))} > 0 AS has_tables FROM documents"


@plan
def w7_active_heading(d):
    """The headings above each block, by level: one of the same level takes the place of the last, deeper ones end with it.

    A heading's level is the number of its marks or the depth of its number, else 1. A few blocks of a fixture have levels.
    """
    own = rows((-1, 0, "# A"), (-1, 1, "x"), (-1, 2, "## B"), (-1, 3, "### C"), (-1, 4, "## D"), (-1, 5, "y"), (-1, 6, "# E"), (-1, 7, "1.2.3 Deep"), (-1, 8, "z"), names="doc_id, block_id, text")
    marks, number = d.extract("text", "^(#{1,6})", 1), d.extract("text", r"^\d+(?:\.\d+)*", 0)
    level = f"CASE WHEN {marks} <> '' THEN length({marks}) WHEN {number} <> '' THEN least(6, 1 + length({number}) - length(replace({number}, '.', ''))) ELSE 1 END"
    every = f"SELECT doc_id, block_id, text, CASE WHEN block_type = 'heading' THEN {level} END AS lv FROM ({classified(d)}) c UNION ALL SELECT doc_id, block_id, text, CASE WHEN length(text) > 1 THEN {level} END FROM {own} o"
    over = "PARTITION BY doc_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    seen = ", ".join(f"{d.last_seen(f'CASE WHEN lv = {k} THEN text END', over)} AS t{k}, coalesce({d.last_seen(f'CASE WHEN lv = {k} THEN block_id END', over)}, -1) AS b{k}" for k in range(1, 7))
    path = ", ".join(f"CASE WHEN b{k} > greatest(-1, {', '.join(f'b{j}' for j in range(1, k)) or '-1'}) THEN t{k} END" for k in range(1, 7))
    return f"SELECT doc_id, block_id, coalesce(nullif(concat_ws(' > ', {path}), ''), 'Root') AS heading FROM (SELECT doc_id, block_id, {seen} FROM ({every}) e) s"


@plan
def w9_previous_block(d):
    return f"SELECT doc_id, block_id, lag(block_id) OVER (PARTITION BY doc_id ORDER BY block_id) AS previous_id FROM ({classified(d)}) c WHERE block_type = 'paragraph'"


@plan
def w10_relationships(d):
    last = lambda kind: d.last_seen(f"CASE WHEN block_type = '{kind}' THEN block_id END", "PARTITION BY doc_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    return f"SELECT doc_id, block_id, {last('heading')} AS belongs_to, {last('paragraph')} AS previous, coalesce({last('table')}, {last('caption')}) AS related_to FROM ({classified(d)}) c"


@plan
def a44_section_rollup(d):
    grp = "sum(CASE WHEN block_type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"SELECT doc_id, {d.int('section')} AS section, min(block_id) AS first_block, max(block_id) AS last_block, {d.long('sum(length(text))')} AS n_chars FROM (SELECT *, {grp} AS section FROM ({classified(d)}) c) s GROUP BY doc_id, section"


@plan
def s16_batched_pages(d):
    """Blocks numbered again by batches of ten, as batched ingest does."""
    return f"SELECT doc_id, concat('b', {d.int('floor(block_id / 10)')}, '_', block_id % 10) AS element_id, {d.int('1 + floor(block_id / 10)')} AS page FROM ({blocks(d)}) b"


@plan
def s12_table_grid(d):
    """Cells of lines that are table rows."""
    cell = d.split(d.sub("text", r"^\s*\||\|\s*$", ""), r"\|")
    return f"SELECT doc_id, block_id AS row_no, {d.int('col')} AS col_no, trim(cell) AS cell FROM (SELECT * FROM ({classified(d)}) c WHERE block_type = 'table') t {d.each(cell, 'cell', 'col')}"


@frame(lambda d: f"SELECT lang, count(*) AS n_docs, {d.long('sum(length(text))')} AS n_chars FROM documents GROUP BY lang")
def s8_language_profile(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))
