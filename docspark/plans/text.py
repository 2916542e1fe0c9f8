"""Text functions over whole documents: normalisation, tokens, predicates, slugs."""

from __future__ import annotations

from docspark.plans.dialect import SparkSql, plan, rows

# The patterns of the text rules.
URL = r"(?i)(https?://\S+|www\.\S+)"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
MD_HEADING = r"^\s{0,3}#{1,6}\s+"
MD_EMPHASIS = r"(\*\*|\*|__|_|`)"
MD_TABLE_ROW = r"^\s*\|.*\|\s*$"
MD_TABLE_RULE = r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$"
PAGE_NUMBER = r"(?i)^\s*(page\s+)?\d+\s*(/\s*\d+)?\s*$"
ROMAN = r"(?i)^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
ACRONYM = r"^[A-Z]{2,}[A-Z0-9]*$"
CITATION = r"^\[\d+(,\s*\d+)*\]$|^\(\s*[A-Za-z.,&\s]+,?\s*\d{4}[a-z]?\s*\)$"
MARKS, PLAIN_MARKS = "‘’‚‛“”„‟‐‑‒–—―", "''''" + '""""' + "------"
# Words that a query is stripped of.
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down "
    "in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()


#: A document's text; of a null text nothing.
BODY = "coalesce(text, '')"


def lines(d: SparkSql, text: str = "text") -> str:
    return d.split(f"coalesce({text}, '')", "\n")


def strip_markdown(d: SparkSql, text: str) -> str:
    kept = d.keep(d.split(text, "\n"), "l", f"NOT ({d.like('l', MD_TABLE_ROW)} OR {d.like('l', MD_TABLE_RULE)})")
    return d.join(d.map(kept, "l", d.sub(d.sub("l", MD_HEADING, ""), MD_EMPHASIS, "")), "\n")


def no_links(d: SparkSql, text: str) -> str:
    return d.sub(d.sub(text, URL, ""), EMAIL, "")


def normalised(d: SparkSql, text: str) -> str:
    """Quotes and dashes to ASCII, control characters out, words joined over line ends, spaces and blank lines collapsed.

    For text in composed form; compatibility forms are a step of their own (``operators.normalise``).
    """
    t = f"translate({text}, {d.text(MARKS)}, {d.text(PLAIN_MARKS)})"
    t = d.sub(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    t = d.sub(t, r"(\w)-\n(\w)", d.group(1) + d.group(2))
    t = d.sub(d.sub(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return f"trim({d.join(d.map(d.split(t, chr(10)), 'l', 'trim(l)'), chr(10))})"


def words(d: SparkSql, text: str) -> str:
    """Tokens of letters, digits and underscores."""
    return d.keep(d.split(f"lower({text})", r"[^\p{L}\p{N}_]+"), "w", "w <> ''")


@plan
def f1_strip_markdown(d):
    return f"SELECT doc_id, {d.int('length(' + strip_markdown(d, 'text') + ')')} AS n_chars, md5({strip_markdown(d, 'text')}) AS digest FROM documents"


@plan
def f2_remove_urls_and_emails(d):
    return f"SELECT doc_id, {d.int('length(text) - length(' + no_links(d, 'text') + ')')} AS n_removed FROM documents"


@plan
def f3_token_predicates(d):
    token = rows(("12",), ("Page 3",), ("3 / 10",), ("iv",), ("XII",), ("NASA",), ("Nasa",), ("B2B",), ("[1, 2]",), ("(Smith, 2020)",), ("word",), ("",), names="token")
    both = f"SELECT token FROM {token} t UNION ALL SELECT source FROM documents"
    bare = d.sub("token", "^[.]+|[.]+$", "")
    roman = f"({d.like(bare, ROMAN)} AND {bare} <> '')"
    return f"SELECT token, {d.like('trim(token)', PAGE_NUMBER)} AS is_page_number, {roman} AS is_roman, {d.like('token', ACRONYM)} AS is_acronym, {d.like('trim(token)', CITATION)} AS is_citation FROM ({both}) t"


@plan
def f4_normalise(d):
    return f"SELECT doc_id, {d.int('length(' + normalised(d, 'text') + ')')} AS n_chars, md5({normalised(d, 'text')}) AS digest FROM documents"


@plan
def f10_token_estimate(d):
    n = d.size(d.keep(d.split(BODY, r"\s+"), "w", "w <> ''"))
    return f"SELECT doc_id, {d.int(f'floor({n} * 1.3) + 1')} AS tokens, {d.int(d.size(d.extract_all(BODY, '[0-9A-Za-z_]+')))} AS ascii_words FROM documents"


@plan
def f11_section_slug(d):
    return f"SELECT doc_id, concat('sec_', {d.sub('lower(concat(source, chr(32), lang))', '[^a-z0-9]+', '_')}) AS section_id, concat_ws(' > ', source, lang) AS section_path FROM documents"


@plan
def f12_bm25_tokens(d):
    return f"SELECT doc_id, {d.int(d.size(words(d, 'text')))} AS n_tokens, {d.int(d.size(d.distinct(words(d, 'text'))))} AS n_terms FROM documents"


@plan
def f13_query_preprocess(d):
    q = rows((1, "What is the  Revenue of Acme?"), (2, "Who signed the Contract, and when?"), (3, ""), (4, "the of and"), names="query_id, query")
    stop = d.array(*[f"'{w}'" for w in STOP])
    every = f"SELECT query_id, query FROM {q} q UNION ALL SELECT 100 + item_id, text FROM benchmark"
    kept = d.keep(words(d, "query"), "t", f"NOT {d.has(stop, 't')}")
    return f"SELECT query_id, {d.join(kept, ' ')} AS clean_query FROM ({every}) x"


# Synonyms by pattern, intents by words in the order in which they are tried, and words for readers.
SYNONYMS = (
    ("board", "board of directors leadership corporate governance directors management"), ("chairman", "board chairman chairperson executive chairman leadership corporate governance"),
    ("leadership", "executive committee board of directors management corporate governance"), ("revenue", "turnover sales income financial performance"),
    ("subsidiary", "group company associate joint venture subsidiary companies"), ("managing director", "managing director md executive leadership chief executive officer"),
    ("plant", "manufacturing plant factory site production facility manufacturing unit"), ("product", "products services brand solutions offerings"), ("committee", "audit committee nomination committee board committee"),
)
INTENTS = (
    ("summary", ("summarise", "summarize", "summary", "overview", "synopsis", "outline")), ("timeline", ("timeline", "chronology", "history", "when did", "date of", "chronological", "sequence")),
    ("comparison", ("compare", "comparison", "difference", "versus", "vs", "similarities")), ("financial", ("revenue", "turnover", "income", "sales", "earnings", "profit", "financial", "fy24", "fy25", "crore", "million", "billion")),
    ("board", ("board", "director", "chairman", "managing director", "md", "ceo", "cfo", "chairperson")), ("governance", ("leadership", "executive", "president", "management", "governance")),
    ("committee", ("committee", "board members", "independent director")), ("product", ("product", "services", "offerings", "brands")), ("manufacturing", ("plant", "manufactur", "factory", "site", "production")),
    ("table", ("table", "tabular", "column", "row")), ("image", ("chart", "graph", "diagram", "figure", "image", "illustration")), ("list", ("list", "enumerate", "who are the", "name all", "what are the", "which people", "entities")),
    ("procedure", ("how to", "procedure", "steps", "guide", "instructions", "process")), ("statistics", ("percent", "ratio", "statistics", "stats", "rate", "number of")),
    ("navigation", ("section", "chapter", "page", "navigate", "go to", "find in")), ("explanation", ("explain", "why", "how", "reason")),
)
DETAIL = ("detail", "comprehensive", "extensive")
JARGON = (
    ("knowledge object", "document segment"), ("Knowledge Object", "Document Segment"), ("knowledge objects", "document segments"), ("Knowledge Objects", "Document Segments"), ("chunk", "segment"), ("Chunk", "Segment"), ("chunks", "segments"), ("Chunks", "Segments"),
    ("metadata", "document properties"), ("Metadata", "Document Properties"), ("embedding", "index status"), ("Embedding", "Index Status"), ("embeddings", "index status"), ("Embeddings", "Index Status"), ("inference", "analysis"), ("Inference", "Analysis"),
    ("llm", "audit engine"), ("LLM", "Audit Engine"), ("candidate group", "comparison group"), ("Candidate Group", "Comparison Group"), ("candidate groups", "comparison groups"), ("Candidate Groups", "Comparison Groups"),
    ("vector database", "document index"), ("Vector Database", "Document Index"), ("vector db", "document index"), ("Vector DB", "Document Index"), ("internal id", "segment reference"), ("Internal ID", "Segment Reference"), ("internal ids", "segment references"), ("Internal IDs", "Segment References"),
    ("confidence %", "audit certainty"), ("Confidence %", "Audit Certainty"), ("confidence percentage", "audit certainty"), ("Confidence Percentage", "Audit Certainty"), ("error", "potential inconsistency"), ("Error", "Potential Inconsistency"),
    ("wrong", "appears inconsistent"), ("Wrong", "Appears Inconsistent"), ("incorrect", "possible contradiction"), ("Incorrect", "Possible Contradiction"),
)


@plan
def f14_query_expansion(d):
    """Queries with the synonyms of each word or phrase that they hold, in the rules' order."""
    own = rows((-1, "Annual revenue of the board"), (-2, "Plant committee"), (-3, "the managing director"), (-4, "nothing here"), names="query_id, query")
    every = f"SELECT query_id, query FROM {own} q UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations"
    more = ", ".join(f"CASE WHEN {d.like('lower(query)', f'(^|[^a-z]){w}($|[^a-z])')} THEN {d.text(s)} END" for w, s in SYNONYMS)
    return f"SELECT query_id, query, concat_ws(' ', query, {more}) AS expanded FROM ({every}) q"


def intent(d: SparkSql, query: str) -> str:
    any_of = lambda ws: "(" + " OR ".join(d.contains(f"lower({query})", d.text(w)) for w in ws) + ")"
    cases = [f"WHEN {any_of(INTENTS[0][1])} AND {any_of(DETAIL)} THEN 'detailed_summary'", *(f"WHEN {any_of(ws)} THEN '{name}'" for name, ws in INTENTS)]
    return f"CASE {' '.join(cases)} ELSE 'fact' END"


@plan
def f15_intent(d):
    q = rows((1, "summarise the table on page 3"), (2, "a detailed overview"), (3, "compare both figures"), (4, "when did it start"), (5, "hello"), (6, "why so"), names="query_id, query")
    return f"SELECT query_id, {intent(d, 'query')} AS intent FROM {q} q UNION ALL SELECT 100 + conv_id * 1000 + turn, {intent(d, 'text')} FROM conversations"


@plan
def f17_clean_items(d):
    item = d.map(d.keep(lines(d), "l", "length(trim(l)) > 0"), "l", "substr(trim(l), 1, 80)")
    first = f"slice({d.distinct(item)}, 1, 4)" if d.__class__ is SparkSql else f"list_slice(list_filter({item}, lambda x, i: list_position({item}, x) = i), 1, 4)"
    return f"SELECT doc_id, {d.join(first, ' | ')} AS items FROM documents"


@plan
def f18_url_domain(d):
    host = d.extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1)
    return f"SELECT page_id, {d.sub(f'lower({host})', '^www[.]', '')} AS domain, {d.at(d.split(d.sub(f'lower({host})', '^www[.]', ''), '[.]'), '0')} AS name FROM pages"


@plan
def f19_jargon(d):
    """Words for readers in place of the engine's own, in the table's order, as singulars come before plurals."""
    t = "text"
    for x, y in JARGON:
        t = f"replace({t}, {d.text(x)}, {d.text(y)})"
    q = rows((-1, "Each chunk of the chunks has an embedding for the LLM; an incorrect Error."), names="doc_id, text")
    return f"SELECT doc_id, md5({t}) AS digest, {d.int('length(' + t + ')')} AS n_chars FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM {q} q) x"


@plan
def f21_match_case(d):
    q = rows(("Goed", "went"), ("LIBARY", "library"), ("dont", "don't"), ("x", "y"), names="original, suggestion")
    return f"SELECT original, CASE WHEN length(original) > 1 AND original = upper(original) THEN upper(suggestion) WHEN substr(original, 1, 1) = upper(substr(original, 1, 1)) THEN concat(upper(substr(suggestion, 1, 1)), substr(suggestion, 2)) ELSE suggestion END AS replacement FROM {q} q"


@plan
def f22_rule_issue_type(d):
    q = rows(("MORFOLOGIK_RULE_EN",), ("COMMA_PARENTHESIS",), ("PASSIVE_STYLE",), ("VERB_TENSE",), ("AGREEMENT",), names="rule_id")
    return f"SELECT rule_id, CASE WHEN {d.contains('rule_id', d.text('MORFOLOGIK'))} OR {d.contains('rule_id', d.text('SPELL'))} THEN 'spelling' WHEN {d.contains('rule_id', d.text('COMMA'))} OR {d.contains('rule_id', d.text('PUNCT'))} THEN 'punctuation' WHEN {d.contains('rule_id', d.text('TENSE'))} THEN 'tense' WHEN {d.contains('rule_id', d.text('STYLE'))} THEN 'style' ELSE 'grammar' END AS issue_type FROM {q} q"


@plan
def f23_html_escape(d):
    t = "text"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = f"replace({t}, {d.text(a)}, {d.text(b)})"
    return f"SELECT doc_id, {d.int('length(' + t + ') - length(text)')} AS n_added, md5({t}) AS digest FROM documents"


@plan
def f25_query_templates(d):
    return f"SELECT DISTINCT source, concat(source, ' competitors in ', lang) AS q1, concat('top companies like ', source) AS q2 FROM documents"
