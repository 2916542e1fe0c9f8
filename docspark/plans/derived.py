"""What reviews of a corpus work on, derived from its tables: chunks, objects, claims, entities, ambiguities, findings, elements, hits, profiles.

Each relation is one over the tables, together with a few rows of a fixture that the tables' text hardly triggers (documents
with negative ids). All are keyed by document.
"""

from __future__ import annotations

from docspark.plans.dialect import SPARK, rows, table, views
from docspark.plans.layout import classified, paragraphs
from docspark.plans.retrieval import top

CHUNKS = rows(
    (-1, 0, 1, "c1", "The fee is 18 percent of the price, paid as soon as possible."), (-1, 1, 2, "c1", "Acme pays the fee of 12 percent. The customer must sign."), (-1, 2, 2, "c2", "Staff must report soon, or the client shall sign at a later date."),
    (-1, 3, 3, "c2", "It may be approximately 5 days. This section applies to the EBITDA of Bolt."), (-2, 0, 1, "c3", "The employee goed to the libary and must report; the peoples wasnt there."), (-2, 1, 1, "c3", "Personnel shall go, see Section 6.2 and Table 3, within 30 days of $12.50."),
    (-3, 0, 1, "c4", "Report no. 17: Police seized two rifles and an AK-47 in Dimapur, Nagaland on 12/03/2021. Ramesh Kumar Das of the Acme Relief Group left the Barak Valley in 2022."),
    names="doc_id, chunk_no, page, cluster_id, text",
)
OBJECTS = rows(
    (-1, "k1", "The fee is ten thousand five hundred (1050) dollars.", 1, "Root > 1.1 Introduction", "1.1 Introduction"),
    (-1, "k2", "See page 5 for details.", 1, "Root > 1.1 Introduction", "1.1 Introduction"),
    (-1, "k3", "See page 2 and Section 1.1 for details.", 2, "Root > 1.3 Scope", "1.3 Scope"),
    (-1, "k4", "Effective date is 2024-01-15 for all.", 2, "Root > 1.3 Scope", "1.3 Scope"),
    (-1, "k5", "Effective date is 2024-02-20 for all. Section 6.2 applies.", 2, "Root > 1.1 Introduction", "1.1 Introduction"),
    (-1, "k6", "Revenue of 5 crore and twenty (20) staff, or 3 million.", 2, "Root > 1.4 Results", "1.4 Results"),
    names="doc_id, knowledge_id, text, page, section_path, heading",
)
FINDINGS = rows(
    (-1, "f01", "policy conflict", "Leave policy", "Section 4 allows remote work but section 9 forbids it", "Governance policy conflict", 0.92, 3, "Policies"),
    (-1, "f02", "policy conflict", "Leave policy", "Section 4 allows remote work but section 9 forbids it again", "Governance policy conflict", 0.95, 9, "Policies"),
    (-1, "f03", "undefined acronym", "Acronym EBITDA", "EBITDA rose in the second quarter of the year", "never defined", 0.81, 2, "Results"),
    (-1, "f04", "Numerical Mismatch", "Headcount", "520 employees against 540 employees in the annex", "financial statement differs", 0.97, 5, "Staff"),
    (-1, "f05", "vague wording", "OVERVIEW", "OVERVIEW", "", 0.9, 1, "Overview"),
    (-1, "f06", "contradiction", "Penalty clause", "A penalty applies to late delivery of any order", "legal penalty differs", 0.88, 7, "Contract"),
    (-1, "f07", "Reference Conflict", "Missing section", "See Section 6.2 for the details of the process", "cross-reference to a missing section", 0.75, 4, "Process"),
    (-1, "f08", "vague wording", "Sample", "lorem ipsum placeholder content for this page", "", 0.99, 6, "Draft"),
    (-1, "f09", "Unsupported Claim", "Market leader", "We are the leading supplier in every market", "no evidence", 0.55, 8, "Market"),
    (-1, "f10", "Data Quality", "Formatting", "Formatting of the tables differs between chapters", "formatting only", 0.72, 10, "Annex"),
    names="doc_id, finding_id, raw_category, title, quote, explanation, confidence, page, section",
)
ELEMENTS = rows((-1, 1, "heading", "1 Scope", None, None), (-1, 2, "text", "All staff must report.", None, None), (-1, 3, "list", "* a - b", None, None), (-1, 4, "table", "| a | b |", 6, None), (-1, 5, "picture", "", 7, "chart"), (-1, 6, "caption", "Table 1: rates", None, None), (-1, 7, "caption", "Figure 1: map", None, None), (-1, 8, "code", "x = 1", None, None), names="doc_id, element_id, kind, text, caption_id, description")
CELLS = rows((-1, 1, 0, 0, 1, 2, "Rate"), (-1, 1, 1, 0, 1, 1, "a"), (-1, 1, 1, 1, 1, 1, "18"), (-1, 2, 0, 0, 2, 1, "x"), names="doc_id, table_id, row_no, col_no, row_span, col_span, text")
HITS = rows(
    (-1, "Acme Industries Ltd | Official Site", "https://www.acme.com/about", 0.9), (-2, "Acme Industries annual report", "https://acme.com/report", 0.8), (-3, "Bolt Systems Pvt. Ltd.", "https://bolt.io/", 0.7),
    (-4, "Top ten competitors of Target Corp", "https://www.wikipedia.org/wiki/Top", 0.95), (-5, "Target Corp careers", "https://target.com/jobs", 0.9), (-6, "Bolt Systems overview", "https://www.bolt.io/overview", 0.6), (-7, "Bolt", "https://bolt.io/", 0.6),
    names="hit_id, title, url, score",
)
PROFILES = rows(("Target", "service", "design"), ("Target", "service", "build"), ("Acme", "service", "design"), ("Acme", "technology", "cloud"), ("Bolt", "service", "audit"), ("Bolt", "technology", "cloud"), names="company, attribute, value")

# Wrong words with their type, severity and correction; vague, approximate, temporal and unclear phrases.
WRONG_WORDS = (
    ("goed", "vague wording", "High", "went"), ("libary", "undefined terminology", "Medium", "library"), ("enviroment", "undefined terminology", "Low", "environment"), ("librerian", "undefined terminology", "Medium", "librarian"),
    ("dont", "vague wording", "Low", "do not"), ("ten minute", "numerical ambiguity", "Medium", "ten minutes"), ("everydays", "temporal ambiguity", "Medium", "every day"), ("peoples", "vague wording", "Low", "people"),
    ("lifes", "undefined terminology", "Medium", "lives"), ("childrens", "vague wording", "Low", "children"), ("alot", "vague wording", "Low", "a lot"), ("suppose to", "weak instructions", "Medium", "supposed to"),
    ("wasnt", "vague wording", "Low", "was not"), ("informations", "vague wording", "High", "information"), ("worry", "vague wording", "Medium", "worried"),
)
PHRASES = (
    ("as soon as possible|asap", "vague wording", "High", 0.85), ("in a timely manner|timely manner|reasonable time|at earliest convenience", "vague wording", "Medium", 0.85), ("subject to change|to be decided|tbd", "vague wording", "Medium", 0.85),
    ("as appropriate|at discretion|discretionary", "vague wording", "Medium", 0.85), (r"approximately \d+|nearly \d+|about \d+|around \d+|up to \d+|\d+ or more", "numerical ambiguity", "Medium", 0.82),
    ("in due course|future date|at a later date", "temporal ambiguity", "Medium", 0.80), ("this section", "pronoun ambiguity", "Medium", 0.80), ("these policies", "pronoun ambiguity", "Medium", 0.80), ("they state", "pronoun ambiguity", "Medium", 0.80),
    ("it requires", "pronoun ambiguity", "Medium", 0.80), ("this requirement", "pronoun ambiguity", "Medium", 0.80),
)
BOILERPLATE = ("normal course of business", "standard operating procedure")


# Places, weapons and groups that chunks are searched for, and words that tell organisations and places.
STATES = ("Assam", "Nagaland", "Manipur", "Meghalaya", "Tripura", "Mizoram", "Arunachal Pradesh", "Sikkim")
REGIONS, DISTRICTS = ("Northeast", "Barak Valley", "Brahmaputra Valley"), ("Kamrup", "Cachar", "Karbi Anglong", "Dimapur", "Kohima", "Imphal")
WEAPONS = ("rifle", "pistol", "carbine", "ammunition", "grenade", "explosive", "weapon", "arms", "mortar", "bullet", "ak-47", "insurgent")
GROUPS = ("insurgents", "militants", "police", "army", "security forces", "civilian", "authority")
OF_ORGANISATIONS, OF_PLACES, OF_LAYOUT = "inc|corp|org|dept|force|police|army|committee|group", "valley|district|state|india|river|town", "page|figure|table"


def whole(pattern: str, flags: str = "(?i)") -> str:
    """A pattern for whole words, whose first group is the match; word borders that both engines read alike."""
    return flags + r"(?:^|[^\p{L}\p{N}_])(" + pattern + r")(?:$|[^\p{L}\p{N}_])"


def stored(name: str, sql):
    """A relation that plans read by name; the engine writes it once for a query."""

    @table(name)
    def made(spark, sf_dir):
        text = sql(SPARK)
        views(spark, sf_dir, text)
        return spark.sql(text)

    return lambda d: f"({d.stored(name, sql)})"


def _chunks(d) -> str:
    own = f"SELECT p.doc_id, p.paragraph_id AS chunk_no, {d.int('1 + floor(p.paragraph_id / 10)')} AS page, t.source AS cluster_id, p.text FROM ({paragraphs(d)}) p JOIN documents t ON p.doc_id = t.doc_id"
    every = f"SELECT doc_id, chunk_no, page, cluster_id, text FROM {CHUNKS} c UNION ALL {own}"
    return f"SELECT doc_id, {d.long('chunk_no')} AS chunk_no, concat({d.string('doc_id')}, '_chunk_', lpad({d.string('chunk_no')}, 4, '0')) AS chunk_id, page, cluster_id, text FROM ({every}) e"


def _objects(d) -> str:
    """Blocks with the heading above each; a heading stands under itself."""
    last = d.last_seen("CASE WHEN block_type = 'heading' THEN text END", "PARTITION BY doc_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    own = f"SELECT doc_id, concat({d.string('doc_id')}, '_', lpad({d.string('block_id')}, 6, '0')) AS knowledge_id, text, {d.int('1 + floor(block_id / 10)')} AS page, coalesce({last}, 'Root') AS heading FROM ({classified(d)}) c"
    return f"SELECT doc_id, knowledge_id, text, page, section_path, heading FROM {OBJECTS} o UNION ALL SELECT doc_id, knowledge_id, text, page, concat('Root > ', heading), heading FROM ({own}) x"


def _claims(d) -> str:
    """Sentences of more than twelve characters, numbered in their chunk."""
    each = f"SELECT doc_id, chunk_id, trim(s) AS text, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) - 1 AS no FROM {chunks(d)} c {d.each(d.split('text', '[.!?]+'), 's', 'pos')} WHERE length(trim(s)) > 12"
    return f"SELECT doc_id, chunk_id, concat(chunk_id, '_claim_', lpad({d.string('no')}, 3, '0')) AS claim_id, text FROM ({each}) e"


def _entities(d) -> str:
    """The first four capitalised words of a chunk by the alphabet."""
    names = d.keep(d.split("text", r"[^\p{L}\p{N}_]+"), "w", d.like("w", "^[A-Z][a-z]+$"))
    kind = f"CASE WHEN {d.contains('lower(text)', d.text('company'))} OR {d.contains('lower(text)', d.text('department'))} THEN 'Organization' ELSE 'Person' END"
    each = f"SELECT DISTINCT doc_id, chunk_id, {kind} AS kind, name FROM {chunks(d)} c {d.each(names, 'name', 'pos')}"
    four = top(each, "chunk_id", "name", 4)
    return f"SELECT doc_id, chunk_id, concat(chunk_id, '_ent_', lpad({d.string('rnk - 1')}, 3, '0')) AS entity_id, name AS text, kind FROM ({four}) f"


def _any(patterns) -> str:
    """What a text has if any of ``patterns`` matches whole words of it, or an acronym does: one look instead of one for each."""
    return r"(?<![\p{L}\p{N}_])(?:(?i:" + "|".join(patterns) + r")|[A-Z]{2,})(?![\p{L}\p{N}_])"


def _ambiguities(d) -> str:
    """Phrases that leave something open: the first match of each rule in a chunk, each phrase once."""
    rules = [(w, kind, sev, 0.85, put) for w, kind, sev, put in WRONG_WORDS] + [(p, kind, sev, conf, None) for p, kind, sev, conf in PHRASES]
    hits = d.array(*[d.extract("text", whole(r[0]), 1) for r in rules], d.extract("text", whole("[A-Z]{2,}", ""), 1))
    table_ = rows(*((i, *r[1:]) for i, r in enumerate([*rules, ("", "undefined acronym", "Medium", 0.8, None)])), names="rule_no, kind, severity, confidence, put")
    plain = " AND ".join(f"NOT {d.contains('lower(text)', d.text(b))}" for b in BOILERPLATE)
    source = chunks(d) if d.__class__.__name__ == "DuckSql" else f"(SELECT * FROM {chunks(d)} k WHERE {d.like('text', _any(r[0] for r in rules))})"
    each = f"SELECT c.doc_id, c.chunk_id, c.cluster_id, c.page, c.text, quote, {d.int('pos')} AS rule_no FROM {source} c {d.each(hits, 'quote', 'pos')} WHERE quote <> ''"
    first = f"SELECT *, row_number() OVER (PARTITION BY chunk_id, lower(quote) ORDER BY rule_no) AS again FROM ({each}) e WHERE rule_no NOT BETWEEN {len(WRONG_WORDS)} AND {len(WRONG_WORDS) + 3} OR {plain}"
    place = "strpos" if d.__class__.__name__ == "DuckSql" else "instr"
    evidence = f"concat('...', trim(substr(text, {d.int(f'greatest({place}(text, quote) - 30, 1)')}, {d.int('length(quote) + 60')})), '...')"
    rewrite = "coalesce(replace(text, quote, put), 'State the exact value, date or subject.')"
    number = "row_number() OVER (PARTITION BY chunk_id ORDER BY f.rule_no) - 1"
    return f"SELECT doc_id, chunk_id, cluster_id, page, concat(chunk_id, '_amb_', lpad({d.string(number)}, 3, '0')) AS issue_id, kind, severity, confidence, quote, {evidence} AS evidence, {rewrite} AS rewrite FROM ({first}) f JOIN {table_} r ON f.rule_no = r.rule_no WHERE again = 1"


def _findings(d) -> str:
    """Ambiguities as findings, with their place."""
    own = f"SELECT doc_id, issue_id AS finding_id, kind AS raw_category, concat(upper(substr(kind, 1, 1)), substr(kind, 2), ' ', quote) AS title, evidence AS quote, concat('The phrase ', quote, ' leaves it open') AS explanation, confidence, page, cluster_id AS section FROM {ambiguities(d)} a"
    return f"SELECT doc_id, finding_id, raw_category, title, quote, explanation, confidence, page, section FROM {FINDINGS} f UNION ALL {own}"


def _elements(d) -> str:
    """Blocks as elements; a table or picture has the caption that follows it."""
    kind = "CASE block_type WHEN 'paragraph' THEN 'text' ELSE block_type END"
    after = "lead(block_type) OVER (PARTITION BY doc_id ORDER BY block_id)"
    own = f"SELECT doc_id, {d.long('block_id + 1')} AS element_id, {kind} AS kind, text, CASE WHEN block_type = 'table' AND {after} = 'caption' THEN {d.long('block_id + 2')} END AS caption_id, CAST(NULL AS {'VARCHAR' if d.__class__.__name__ == 'DuckSql' else 'STRING'}) AS description FROM ({classified(d)}) c"
    return f"SELECT doc_id, element_id, kind, text, caption_id, description FROM {ELEMENTS} e UNION ALL {own}"


def _cells(d) -> str:
    """Cells of blocks that are table rows; runs of neighbouring rows are a table."""
    runs = f"SELECT doc_id, text, block_id, block_id - row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS run FROM ({classified(d)}) c WHERE block_type = 'table'"
    numbered = f"SELECT doc_id, run AS table_id, text, row_number() OVER (PARTITION BY doc_id, run ORDER BY block_id) - 1 AS row_no FROM ({runs}) r"
    cell = d.split(d.sub("text", r"^\s*\||\|\s*$", ""), r"\|")
    own = f"SELECT doc_id, {d.long('table_id')} AS table_id, {d.int('row_no')} AS row_no, {d.int('pos')} AS col_no, 1 AS row_span, 1 AS col_span, trim(cell) AS text FROM ({numbered}) n {d.each(cell, 'cell', 'pos')}"
    return f"SELECT doc_id, table_id, row_no, col_no, row_span, col_span, text FROM {CELLS} c UNION ALL {own}"


def _hits(d) -> str:
    """Pages as hits of a web search: title, address, and a score that falls with the place."""
    title = d.extract("html", "(?i)<title>([^<]*)</title>", 1)
    return f"SELECT {d.long('hit_id')} AS hit_id, title, url, score FROM {HITS} h UNION ALL SELECT page_id, {title}, url, round(CAST(0.4 + 0.5 / (1 + page_id % 10) AS DOUBLE), 4) FROM pages"


def _profiles(d) -> str:
    """Sources as companies: their languages and their most frequent longer words."""
    from docspark.plans.text import words

    n = f"SELECT source, term, count(*) AS n FROM documents {d.each(words(d, 'text'), 'term', 'pos')} WHERE {d.like('term', '^[a-z]{6,}$')} GROUP BY source, term"
    return f"SELECT company, attribute, value FROM {PROFILES} p UNION ALL SELECT DISTINCT source, 'language', lang FROM documents UNION ALL SELECT source, 'technology', term FROM ({top(n, 'source', 'n DESC, term', 5)}) t"


chunks, objects, claims, entities, ambiguities = stored("chunk_rows", _chunks), stored("object_rows", _objects), stored("claim_rows", _claims), stored("entity_rows", _entities), stored("ambiguity_rows", _ambiguities)
findings, elements, cells, hits, profiles = stored("finding_rows", _findings), stored("element_rows", _elements), stored("cell_rows", _cells), stored("hit_rows", _hits), stored("profile_rows", _profiles)
