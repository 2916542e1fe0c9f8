"""Findings and consistency checks: suppression, severity, consolidation, ratings, local checks."""

from __future__ import annotations

from docspark.plans import derived
from docspark.plans.derived import ambiguities, chunks, claims, entities, findings, objects  # noqa: F401
from docspark.plans.dialect import SPARK, SparkSql, frame, plan, rows, views
from docspark.plans.layout import sentences
from docspark.plans.text import words

# Category names, words that set severities, and suppressed texts.
CATEGORIES = (("vague wording", "Undefined Term"), ("undefined terminology", "Undefined Term"), ("undefined acronym", "Undefined Acronym"), ("policy conflict", "Policy Conflict"), ("contradiction", "Contradictory Statement"), ("numerical ambiguity", "Numerical Inconsistency"), ("Numerical Mismatch", "Numerical Inconsistency"), ("Reference Conflict", "Cross-Reference Error"), ("Data Quality", "Numerical Inconsistency"), ("Unsupported Claim", "Unsupported Claim"))
CRITICAL_WORDS = ("regulatory audit failure", "legal liability", "contract breach", "penalty", "statutory violation", "gender", "statutory disclosure", "board appointment", "secretarial audit", "companies act", "director")
HIGH_WORDS = ("financial mismatch", "contradiction", "discrepancy", "policy conflict", "revenue")
HEADINGS = (
    "OUR VISION", "OUR MISSION", "VISION", "MISSION", "PROJECTS", "OVERVIEW", "STRENGTHS", "CONTENT", "DOCUMENT", "SECTION", "OUR HERITAGE", "TABLE OF CONTENTS", "CONTENTS PAGE", "INDEX PAGE", "CHAIRMAN'S MESSAGE", "CORPORATE PHILOSOPHY",
    "ACKNOWLEDGEMENTS", "FORWARD LOOKING STATEMENTS", "COMPANY PROFILE", "CONTACT", "CONTACT US", "INDUSTRY", "HEADQUARTERS", "BOARD & KEY LEADERSHIP", "BOARD AND KEY LEADERSHIP", "KEY LEADERSHIP", "WEBSITE", "EMAIL", "ADDRESS",
    "ABOUT US", "EXECUTIVE SUMMARY", "INTRODUCTION", "FINANCIAL PERFORMANCE", "SERVICES", "PRODUCTS", "LEADERSHIP", "MANAGEMENT", "CORPORATE INFORMATION", "REGISTERED OFFICE", "FINANCIAL ASSETS", "NET DEBT", "TOTAL EQUITY", "SENSITIVITY ANALYSIS",
    "FIXED RATE INSTRUMENTS", "VARIABLE RATE INSTRUMENTS", "OUR GOVERNANCE COMMITMENT", "EDUCATION AND SKILL DEVELOPMENT", "GROWTH", "TABLE 1", "APPENDIX",
)
PLACEHOLDERS = (
    "the model processes", "example text", "sample content", "placeholder", "lorem ipsum", "internal test", "test string", "sample paragraph", "chunk analysis", "internal validation", "in this chunk", "claims made in this chunk",
    "unrelated to the provided text", "from the given text", "validation or disvalidation", "information provided in the table", "based on information provided in", "no direct evidence", "the claims and entities", "claims and entities in this chunk",
    "seem unrelated to the provided text", "do not have direct evidence",
)
FACILITIES = ("coal handling plant", "raw material handling plant", "pet coke handling system", "bifpcl bangladesh maitree", "sail dsp", "iocl paradip", "yadadri tps", "ntpc pakri mines", "talcher fertilizer", "wbpdcl power plant", "sagardighi")
CONFLICTS = ("mismatch", "conflict", "contradict", "differ", "incorrect", "broken")
SECTIONS = ("chairman's message", "vision", "mission", "corporate philosophy", "acknowledgements", "forward looking statements", "contents page", "index page")
VAGUE = ("ambiguity", "vague", "spelling", "typo", "pronoun", "unclear", "undefined")
GRID, GRID_TERMS, GRID_COUNTED = r"\|\s*[\d,.-]+\s*\|", "(?i)financial assets|net debt|total equity|fixed rate instruments|variable rate instruments|sensitivity analysis", "(?i)financial assets|net debt|total equity|fixed rate|variable rate"
SUPPRESSED = (
    r"(?i)^\s*(?:our vision|our mission|vision|mission|projects|overview|strengths|content|document|section|our heritage|company profile|contact|industry|headquarters|board|leadership|website|email|address|phone|tel|fax|about us|growth|table\s*\d+|appendix|our governance commitment|education and skill development)\s*$",
    r"(?i)^\s*(?:https?://|www\.|[\w.+-]+@[\w-]+\.[\w.-]+)\s*$",
    r"(?i)^\s*(?:page\s*\d+|section\s*\d+(?:\.\d+)*)\s*$",
    r"(?i)^\s*\w+\s*(?:is|lacks|undefined|vague|not defined|lacks explanation|lacks context)\s*$",
)
REFERENCE, NUMBERED = r"(?i)\b(?:section|sec\.?)\s*([0-9]+(?:\.[0-9]+)+)\b", r"^\s*([0-9]+(?:\.[0-9]+)*)\b"
SAYS = r"(?i)\b(?:is|are|was|were|has|have|will|must|should|cannot|tbd|asap|etc|or)\b"
NUMBER_WORDS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000, "million": 1_000_000, "billion": 1_000_000_000}


def any_of(d, col: str, items) -> str:
    return "(" + " OR ".join(d.contains(col, d.text(w)) for w in items) + ")"


def rejection(d) -> str:
    """Why a finding is suppressed: the first rule that fits, confidence first; null if none does."""
    q, t = "coalesce(quote, '')", "coalesce(title, '')"
    both = f"lower(concat({q}, ' ', {t}))"
    boiler = f"{any_of(d, f'lower({q})', SECTIONS)} OR {any_of(d, f'lower({t})', SECTIONS)} OR {any_of(d, "lower(coalesce(section, ''))", SECTIONS)}"
    names = ", ".join(map(d.text, HEADINGS))
    exact = f"upper(trim({q})) IN ({names}) OR upper(trim({t})) IN ({names})"
    grid = f"{d.like(q, GRID)} OR {d.like(q, GRID_TERMS)}"
    shapes = " OR ".join(d.like(x, p) for p in SUPPRESSED for x in (q, t))
    short = f"length(trim({q})) < 8 AND NOT {d.like(q, SAYS)} AND NOT {any_of(d, both, VAGUE)}"
    counted = f"{d.like(q, GRID)} OR {d.like(q, GRID_COUNTED)}"
    return f"""CASE WHEN confidence < 0.70 THEN 'low confidence' WHEN {any_of(d, f'lower({q})', PLACEHOLDERS)} OR {any_of(d, f'lower({t})', PLACEHOLDERS)} OR {any_of(d, "lower(coalesce(explanation, ''))", PLACEHOLDERS)} THEN 'placeholder'
    WHEN {any_of(d, both, FACILITIES)} AND NOT {any_of(d, both, CONFLICTS)} THEN 'project'
    WHEN {boiler} OR {exact} OR {grid} OR {shapes} OR ({short}) THEN CASE WHEN {counted} THEN 'table' ELSE 'heading' END END"""


def scored(d) -> str:
    """Findings with category, rejection reason, severity, materiality and risk score; the rules' order is their meaning."""
    cat = " ".join(f"WHEN raw_category = {d.text(a)} THEN {d.text(b)}" for a, b in CATEGORIES)
    block = "lower(concat_ws(' ', title, quote, explanation, category))"
    sev = f"""CASE WHEN {any_of(d, block, CRITICAL_WORDS)} THEN 'CRITICAL' WHEN category IN ('Regulatory Risk', 'Compliance Risk', 'Regulatory Disclosure Gap') THEN 'CRITICAL'
    WHEN category IN ('Contradictory Statements', 'Contradictory Statement', 'Numerical Consistency', 'Numerical Inconsistency', 'Policy Conflict', 'Strategic Risk') OR {any_of(d, block, HIGH_WORDS)} THEN 'HIGH'
    WHEN category IN ('Operational Ambiguity', 'Cross-Reference Mismatch', 'Cross-Reference Error', 'Missing Evidence', 'Incomplete Information', 'Undefined Acronym') THEN 'MEDIUM'
    WHEN category IN ('Acronym Definition', 'Data Quality', 'Undefined Term', 'Formatting Inconsistency') THEN 'LOW' ELSE 'MEDIUM' END"""
    low = "lower(explanation)"
    risk = f"""CASE severity WHEN 'CRITICAL' THEN CASE WHEN {any_of(d, low, ('statutory', 'financial', 'legal', 'penalty'))} THEN 10 ELSE 9 END WHEN 'HIGH' THEN CASE WHEN {any_of(d, low, ('governance', 'policy'))} THEN 8 ELSE 7 END
    WHEN 'MEDIUM' THEN CASE WHEN {any_of(d, low, ('reference',))} THEN 6 ELSE 5 END ELSE CASE WHEN {any_of(d, low, ('formatting',))} THEN 2 ELSE 3 END END"""
    with_cat = f"SELECT *, CASE {cat} ELSE raw_category END AS category, {rejection(d)} AS rejection FROM {findings(d)} f"
    with_sev = f"SELECT *, {sev} AS severity FROM ({with_cat}) c"
    return f"SELECT *, CASE severity WHEN 'CRITICAL' THEN 'Material' WHEN 'HIGH' THEN 'Material' WHEN 'MEDIUM' THEN 'Moderate' ELSE 'Informational' END AS materiality, {risk} AS risk_score FROM ({with_sev}) s"


RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END"


def consolidated(d) -> str:
    """One finding for each category and topic (the first three longer words, sorted)."""
    topic = d.keep(words(d, "concat(title, ' ', quote)"), "w", f"{d.like('w', '^[a-z]{4,}$')} AND w NOT IN ('the', 'this', 'that', 'from', 'with', 'have', 'been', 'where')")
    three = f"slice({topic}, 1, 3)" if isinstance(d, SparkSql) and d.__class__ is SparkSql else f"list_slice({topic}, 1, 3)"
    keyed = f"SELECT *, {d.join(d.sorted(three), '_')} AS topic FROM ({scored(d)}) s WHERE rejection IS NULL"
    return f"SELECT doc_id, category, topic, min(finding_id) AS finding_id, count(*) AS occurrences, max(confidence) AS confidence, max_by(quote, concat({d.string('confidence')}, finding_id)) AS quote, min_by(severity, {RANK}) AS severity, max(risk_score) AS risk_score, {d.strings('concat(chr(80), page)', ', ', 'page, finding_id')} AS locations FROM ({keyed}) k GROUP BY doc_id, category, topic"


@plan
def f47_scored_findings(d):
    return f"SELECT finding_id, category, severity, materiality, risk_score FROM ({scored(d)}) s"


@plan
def f47_risk_reason(d):
    return f"SELECT finding_id, CASE WHEN risk_score >= 9 THEN 'statutory or financial contradiction' WHEN risk_score >= 7 THEN 'governance or material policy issue' WHEN risk_score >= 4 THEN 'reference error or incomplete disclosure' ELSE 'naming or formatting' END AS risk_reason, CASE WHEN confidence >= 0.9 THEN 'verbatim' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.7 THEN 'moderate' ELSE 'low' END AS confidence_level FROM ({scored(d)}) s"


@plan
def p15_suppressed(d):
    return f"SELECT finding_id, coalesce(rejection, 'kept') AS outcome FROM ({scored(d)}) s"


@plan
def p16_confident_findings(d):
    return f"SELECT finding_id, confidence FROM {findings(d)} f WHERE confidence >= 0.70"


@plan
def p17_confirmed_split(d):
    return f"SELECT CASE WHEN rejection IS NULL THEN 'confirmed' ELSE 'rejected' END AS status, count(*) AS n, md5({d.strings('finding_id', ',', 'finding_id')}) AS ids FROM ({scored(d)}) s GROUP BY CASE WHEN rejection IS NULL THEN 'confirmed' ELSE 'rejected' END"


@plan
def p18_serious_only(d):
    return f"SELECT finding_id FROM ({scored(d)}) s WHERE severity IN ('MEDIUM', 'HIGH', 'CRITICAL')"


@plan
def a13_consolidated(d):
    return consolidated(d)


@plan
def a14_rejection_funnel(d):
    """Findings by the rule that rejects them; of the others, how many a finding of the same document, category and topic stands for."""
    count = lambda r: d.long(f"count_if(rejection = '{r}')")
    raw = f"SELECT count(*) AS raw, {count('heading')} AS headings, {count('table')} AS tables, {count('placeholder')} AS placeholders, {count('project')} AS projects, {count('low confidence')} AS low_confidence FROM ({scored(d)}) s"
    kept = f"SELECT {d.long('coalesce(sum(occurrences - 1), 0)')} AS duplicates, count(*) AS retained FROM ({consolidated(d)}) c"
    return f"SELECT * FROM ({raw}) r CROSS JOIN ({kept}) k"


@plan
def a16_publication_status(d):
    c = f"SELECT doc_id, count_if(severity = 'CRITICAL') AS c, count_if(severity = 'HIGH') AS h, count(*) AS n FROM ({consolidated(d)}) x GROUP BY doc_id"
    return f"SELECT doc_id, CASE WHEN c = 0 AND h = 0 AND n <= 2 THEN 'Ready for Publication' WHEN c = 0 AND h = 0 THEN 'Requires Minor Revision' WHEN c = 0 AND h <= 3 THEN 'Compliance Review Recommended' ELSE 'Requires Major Revision' END AS label FROM ({c}) y"


@plan
def a17_overall_rating(d):
    c = f"SELECT doc_id, count_if(severity = 'CRITICAL' AND materiality = 'Material') AS c, count_if(severity = 'HIGH') AS h, count_if(materiality = 'Material') AS m, count(*) AS n FROM ({scored(d)}) s WHERE rejection IS NULL GROUP BY doc_id"
    return f"SELECT doc_id, CASE WHEN c >= 1 OR m >= 3 THEN 'CRITICAL' WHEN h >= 2 OR m >= 1 THEN 'HIGH' WHEN n > 0 THEN 'MEDIUM' ELSE 'LOW' END AS rating FROM ({c}) y"


@plan
def a18_quality_score(d):
    s = "100 - 10 * count_if(severity = 'CRITICAL') - 5 * count_if(severity = 'HIGH') - 2 * count_if(severity = 'MEDIUM') - count_if(severity = 'LOW')"
    return f"SELECT doc_id, {d.int(f'least(100, greatest(50, {s}))')} AS score FROM ({consolidated(d)}) c GROUP BY doc_id"


@plan
def a19_category_histogram(d):
    known = rows(("Policy Conflict",), ("Numerical Inconsistency",), ("Contradictory Statement",), ("Compliance Risk",), ("Missing Evidence",), ("Undefined Term",), names="category")
    return f"SELECT k.category, count(s.finding_id) AS n FROM {known} k LEFT JOIN ({scored(d)}) s ON k.category = s.category GROUP BY k.category"


@plan
def a20_verification_summary(d):
    return f"SELECT count(*) AS total, {d.long('count_if(rejection IS NOT NULL)')} AS rejected, round(100.0 * count_if(rejection IS NOT NULL) / count(*), 2) * CAST(1 AS DOUBLE) AS rejected_pct FROM ({scored(d)}) s"


@plan
def a40_dedup_by_prefix(d):
    return f"SELECT doc_id, category, substr(lower(title), 1, 35) AS prefix, count(*) AS n, CASE WHEN count(DISTINCT page) > 1 THEN concat('Multiple Locations (', least(count(DISTINCT page), 3), ')') ELSE concat('Page ', min(page)) END AS location FROM ({scored(d)}) s GROUP BY doc_id, category, substr(lower(title), 1, 35)"


@plan
def a41_severity_breakdown(d):
    return f"SELECT severity, count(*) AS n, max(risk_score) AS top_risk FROM ({scored(d)}) s WHERE rejection IS NULL GROUP BY severity"


@plan
def o8_ranked_findings(d):
    return f"SELECT finding_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {RANK}, risk_score DESC, confidence DESC, finding_id) AS INT) AS place FROM ({consolidated(d)}) c"


@plan
def o19_action_plan(d):
    return f"SELECT finding_id, CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS phase FROM ({consolidated(d)}) c"


@plan
def p26_search_findings(d):
    return f"SELECT finding_id FROM ({scored(d)}) s WHERE severity <> 'LOW' AND {d.contains('lower(concat_ws(chr(32), title, quote, explanation, category, section))', d.text('section'))}"


@plan
def p28_finding_projection(d):
    return f"SELECT finding_id, coalesce(nullif(explanation, ''), quote) AS reason, CASE WHEN length(title) > 8 THEN substr(title, 1, 8) ELSE title END AS short_title FROM {findings(d)} f"


@plan
def f20_category_map(d):
    return f"SELECT DISTINCT raw_category, category FROM ({scored(d)}) s"


@plan
def f24_location_text(d):
    return f"SELECT finding_id, concat('Page ', page, ' · Section: ', CASE WHEN length(section) > 40 THEN concat(substr(section, 1, 40), '...') ELSE section END) AS location FROM {findings(d)} f"


@plan
def f48_tiers(d):
    return f"SELECT finding_id, CASE WHEN risk_score >= 9 THEN 'critical' WHEN risk_score >= 7 THEN 'high' WHEN risk_score >= 4 THEN 'medium' ELSE 'low' END AS tier FROM ({scored(d)}) s"


@plan
def f34_claims(d):
    """Offline extraction: sentences of chunks as claims, with the kinds of statement that their chunk holds."""
    low = "lower(k.text)"
    flags = {"has_obligation": ("must", "shall", "required", "mandatory"), "has_permission": ("may", "can", "optional", "allowed"), "has_condition": ("if", "unless", "except", "provided that")}
    cols = ", ".join(f"{any_of(d, low, words_)} AS {n}" for n, words_ in flags.items())
    return f"SELECT c.claim_id, length(c.text) AS n_chars, {cols} FROM {claims(d)} c JOIN {chunks(d)} k ON c.chunk_id = k.chunk_id"


@plan
def f34_references(d):
    """Figures, tables, sections and relative dates that chunks name."""
    ref, day = d.extract_all("text", "((?:Figure|Table|Section) [0-9]+)", 1), d.extract_all("lower(text)", "(yesterday|today|tomorrow|next month|last year)", 1)
    return f"SELECT chunk_id, v AS target, CASE WHEN v LIKE 'Figure%' THEN 'figure' WHEN v LIKE 'Table%' THEN 'table' WHEN v LIKE 'Section%' THEN 'section' ELSE 'relative date' END AS kind, {d.int('pos')} AS nth FROM (SELECT chunk_id, {ref} AS vs FROM {chunks(d)} c UNION ALL SELECT chunk_id, {day} FROM {chunks(d)} c) x {d.each('vs', 'v', 'pos')}"


@plan
def f29_chunk_enrichment(d):
    """What a chunk names: a report, places, weapons, groups, dates, and runs of capitalised words by kind.

    The engine lowers a chunk and finds its runs once; a word's pattern is tried only where the word is, and those with numbers only where a digit is.
    """
    duck = d.__class__.__name__ == "DuckSql"
    has = lambda n, pattern: d.cued(d.contains("low", d.text(n.lower())), d.like("text", derived.whole(pattern)))
    first = lambda names: "CASE " + " ".join(f"WHEN {has(n, n)} THEN {d.text(n)}" for n in names) + " END"
    every = lambda names: "concat_ws(',', " + ", ".join(f"CASE WHEN {has(n, n + 's?')} THEN {d.text(n)} END" for n in sorted(names)) + ")"
    runs = d.extract_all("text", r"([A-Z][a-zA-Z]+\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)?)", 1)
    day = d.extract_all("text", r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.? \d{1,2},? \d{4})", 1)
    year = d.keep(d.split("text", r"[^\p{L}\p{N}_/-]+"), "w", d.like("w", r"^(19|20)\d{2}$"))
    report, dates = f"nullif({d.extract('text', r'(?i)(?:report|case|bulletin|no)[.]?\s*#?\s*(\d+)', 1)}, '')", d.join(d.sorted(d.distinct(f"({day} || {year})")), ",")
    source = f"{chunks(d)} c"
    if not duck:
        report, dates = f"CASE WHEN has_digit THEN {report} END", f"CASE WHEN has_digit THEN {dates} ELSE '' END"
        source = f"(SELECT chunk_id, text, lower(text) AS low, {d.like('text', '[0-9]')} AS has_digit, {runs} AS runs FROM {source}) c"
        runs = "runs"
    names = lambda test: d.join(d.sorted(d.distinct(d.keep(runs, "w", f"NOT {d.like('lower(w)', derived.OF_LAYOUT)} AND {test}"))), ",")
    org, place = d.like("lower(w)", derived.OF_ORGANISATIONS), d.like("lower(w)", derived.OF_PLACES)
    return f"""SELECT chunk_id, {report} AS report, {first(derived.STATES)} AS state, {first(derived.REGIONS)} AS region, {first(derived.DISTRICTS)} AS district,
    {every(derived.WEAPONS)} AS weapons, {every(derived.GROUPS)} AS groups, {dates} AS dates, {names(org)} AS organisations, {names(f'NOT {org} AND {place}')} AS places, {names(f'NOT {org} AND NOT {place}')} AS people FROM {source}"""


@plan
def f37_values(d):
    """Percentages, sums of money and durations of chunks, as numbers."""
    units = (("percent", r"(\d+(?:\.\d+)?)\s*(?:%|percent)"), ("money", r"\$\s?(\d+(?:\.\d+)?)"), ("duration", r"(?i)(\d+)\s+(?:minutes?|hours?|days?|months?|years?)"))
    every = " UNION ALL ".join(f"SELECT chunk_id, '{u}' AS unit, {d.extract_all('text', p, 1)} AS vs FROM {chunks(d)} c" for u, p in units)
    return f"SELECT chunk_id, unit, CAST(v AS DOUBLE) AS value, {d.int('pos')} AS nth FROM ({every}) x {d.each('vs', 'v', 'pos')}"


@plan
def a23_numeric_conflict(d):
    """Clusters of chunks with more than one number of a unit, and whether they differ."""
    v = f"SELECT c.doc_id, c.cluster_id, c.chunk_id, v FROM {chunks(d)} c {d.each(d.extract_all('text', r'(\d+(?:[.]\d+)?)\s*(?:%|percent)', 1), 'v', 'pos')}"
    return f"SELECT doc_id, cluster_id, count(*) AS n, count(DISTINCT v) > 1 AS conflict FROM ({v}) x GROUP BY doc_id, cluster_id HAVING count(*) > 1"


@plan
def a24_term_variants(d):
    root = "CASE WHEN term IN ('customer', 'client', 'buyer') THEN 'customer' WHEN term IN ('employee', 'staff', 'personnel') THEN 'employee' END"
    t = f"SELECT cluster_id, chunk_id, term, {root} AS root FROM {chunks(d)} c {d.each(words(d, 'text'), 'term', 'pos')}"
    return f"SELECT cluster_id, root, count(DISTINCT term) AS variants, count(DISTINCT chunk_id) AS chunks FROM ({t}) x WHERE root IS NOT NULL GROUP BY cluster_id, root HAVING count(DISTINCT chunk_id) > 1 AND count(DISTINCT term) > 1"


@plan
def a25_duplicate_obligations(d):
    n = f"count_if({d.like('text', '(?i)(must|shall)')})"
    return f"SELECT doc_id, cluster_id, {d.long(n)} AS n FROM {chunks(d)} c GROUP BY doc_id, cluster_id HAVING {n} > 1"


@plan
def a21_duplicate_headings(d):
    return f"SELECT doc_id, section_path, lower(heading) AS heading, count(*) AS n, min(knowledge_id) AS first_id, max(knowledge_id) AS last_id FROM {objects(d)} o GROUP BY doc_id, section_path, lower(heading) HAVING count(*) > 1"


@plan
def a22_mixed_notation(d):
    a, b = d.like("lower(text)", "crore|lakh"), d.like("lower(text)", "million|billion")
    return f"SELECT doc_id, max(CASE WHEN {a} THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN {b} THEN 1 ELSE 0 END) = 1 AS mixed, min(CASE WHEN {a} THEN knowledge_id END) AS first_indian, min(CASE WHEN {b} THEN knowledge_id END) AS first_western FROM {objects(d)} o GROUP BY doc_id"


@plan
def f40_broken_page_refs(d):
    refs = f"SELECT doc_id, knowledge_id, CAST(p AS INT) AS page FROM {objects(d)} o {d.each(d.extract_all('text', '(?i)page ([0-9]+)', 1), 'p', 'pos')}"
    return f"SELECT r.knowledge_id, r.page FROM ({refs}) r JOIN (SELECT doc_id, max(page) AS pages FROM {objects(d)} q GROUP BY doc_id) q ON r.doc_id = q.doc_id WHERE r.page > q.pages"


@plan
def j21_missing_sections(d):
    """References to sections that no heading has, in documents that have numbered headings."""
    refs = f"SELECT doc_id, knowledge_id, s FROM {objects(d)} o {d.each(d.extract_all('text', REFERENCE, 1), 's', 'pos')}"
    have = f"SELECT DISTINCT doc_id, {d.extract('heading', NUMBERED, 1)} AS s FROM {objects(d)} h WHERE {d.like('heading', NUMBERED)}"
    return f"SELECT r.knowledge_id, r.s AS section FROM ({refs}) r JOIN (SELECT DISTINCT doc_id FROM ({have}) n) n ON r.doc_id = n.doc_id LEFT JOIN ({have}) h ON r.doc_id = h.doc_id AND r.s = h.s WHERE h.s IS NULL"


@plan
def j22_value_conflicts(d):
    v = f"SELECT doc_id, knowledge_id, {d.extract('text', '(?i)(effective date is) ([0-9-]+)', 1)} AS what, {d.extract('text', '(?i)(effective date is) ([0-9-]+)', 2)} AS v FROM {objects(d)} o"
    first = f"SELECT *, first_value(v) OVER (PARTITION BY doc_id, what ORDER BY knowledge_id) AS first_v, first_value(knowledge_id) OVER (PARTITION BY doc_id, what ORDER BY knowledge_id) AS first_id FROM ({v}) x WHERE what <> ''"
    return f"SELECT what, first_id, first_v, knowledge_id AS other_id, v AS other_v FROM ({first}) f WHERE v <> first_v AND knowledge_id <> first_id"


@plan
def w8_heading_gaps(d):
    n = f"SELECT doc_id, knowledge_id, CAST({d.extract('heading', '^([0-9]+)[.]([0-9]+)', 1)} AS INT) AS major, CAST({d.extract('heading', '^([0-9]+)[.]([0-9]+)', 2)} AS INT) AS minor FROM {objects(d)} o WHERE {d.like('heading', '^[0-9]+[.][0-9]+')}"
    return f"SELECT knowledge_id, before, minor FROM (SELECT *, lag(minor) OVER (PARTITION BY doc_id, major ORDER BY knowledge_id) AS before FROM ({n}) x) y WHERE minor - before > 1"


@plan
def u3_all_checks(d):
    return f"SELECT 'page' AS check_name, knowledge_id FROM ({f40_broken_page_refs(d)}) a UNION ALL SELECT 'section', knowledge_id FROM ({j21_missing_sections(d)}) b UNION ALL SELECT 'gap', knowledge_id FROM ({w8_heading_gaps(d)}) c"


@plan
def d10_candidate_groups(d):
    """Objects by section: groups of two or more, the first fifteen of each."""
    return f"SELECT doc_id, section_path, knowledge_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section_path ORDER BY knowledge_id) AS rn, count(*) OVER (PARTITION BY doc_id, section_path) AS n FROM {objects(d)} o) x WHERE n >= 2 AND rn <= 15"


def number_value(phrase):
    """The value of English number words as a fold over the words: struct of total, current and whether any was known."""
    from pyspark.sql import functions as F

    table = F.create_map(*[F.lit(x) for kv in ((w, float(n)) for w, n in NUMBER_WORDS.items()) for x in kv])
    values = F.filter(F.transform(F.split(F.regexp_replace(F.lower(phrase), "-", " "), r"\s+"), lambda w: F.element_at(table, w)), lambda v: v.isNotNull())
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("now"), F.lit(False).alias("ok"))

    def step(acc, v):
        scaled = F.greatest(acc["now"], F.lit(1.0)) * v
        big, unit = v >= 1000, v.isin(100.0, 1000.0, 1e6, 1e9)
        total = F.when(unit & big, acc["total"] + scaled).otherwise(acc["total"])
        now = F.when(unit & big, 0.0).when(unit, scaled).otherwise(acc["now"] + v)
        return F.struct(total.alias("total"), now.alias("now"), F.lit(True).alias("ok"))

    return F.aggregate(values, start, step, lambda a: F.when(a["ok"], a["total"] + a["now"]))


_WORDED = r"((?:(?:zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion)[ -]?)+)\s*\((\d+)\)"


@frame(lambda d: rows(("k1", 10500.0, 1050.0), names="knowledge_id, worded, digits"))
def f39_words_against_digits(spark, sf_dir):
    """Numbers in words that differ from the digits in brackets behind them."""
    from pyspark.sql import functions as F

    sql = f"SELECT knowledge_id, text FROM {objects(SPARK)} o"
    views(spark, sf_dir, sql)
    o = spark.sql(sql)
    o = o.withColumn("worded", number_value(F.regexp_extract("text", "(?i)" + _WORDED, 1))).withColumn("digits", F.regexp_extract("text", "(?i)" + _WORDED, 2).try_cast("double"))
    return o.where("worded <> digits").select("knowledge_id", "worded", "digits")
