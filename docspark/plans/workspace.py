"""What a reviewer's workspace asks: issue lists, filters, sorts, decisions, claims with their evidence, object typing."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import ranking
from docspark.plans.dialect import QUERIES, frame, placed, plan, rows
from docspark.plans.derived import WRONG_WORDS, ambiguities, cells, chunks, claims, elements, entities, objects
from docspark.plans.findings import f29_chunk_enrichment, scored
from docspark.plans.layout import TABLE_ROW, classified, paragraphs, sentences
from docspark.plans.retrieval import bm25, edges, fused, neighbours, search_pairs, top
from docspark.plans.spans import bucketed, candidates, decided, gated, merged
from docspark.plans.retrieval import QUERIES as SEARCHES
from docspark.plans.text import words


@plan
def f36_claim_status(d):
    """Claims with a wrong word are partial, and written anew."""
    wrong = " ".join(f"WHEN {d.contains('lower(text)', d.text(w))} THEN replace(text, {d.text(w)}, {d.text(put)})" for w, _, _, put in WRONG_WORDS)
    return f"SELECT claim_id, CASE WHEN rewritten IS NULL THEN 'valid' ELSE 'partial' END AS status, CASE WHEN rewritten IS NULL THEN 0.95 ELSE 0.80 END * CAST(1 AS DOUBLE) AS confidence, coalesce(rewritten, text) AS rewritten FROM (SELECT claim_id, text, CASE {wrong} END AS rewritten FROM {claims(d)} c) x"


@plan
def j2_paragraphs_with_candidates(d):
    hit = f"SELECT DISTINCT p.doc_id, p.paragraph_id FROM ({bucketed(d, paragraphs(d))}) p JOIN ({bucketed(d, candidates(d))}) c ON p.doc_id = c.doc_id AND p.bucket = c.bucket AND c.char_start < p.char_end AND c.char_end > p.char_start"
    return hit


@plan
def j4_issue_place(d):
    """Issues with the sentence and paragraph that hold their start."""
    s = bucketed(d, sentences(d))
    return f"SELECT m.doc_id, m.grp, s.sentence_id, s.paragraph_id FROM (SELECT *, floor(char_start / 64) AS bucket FROM ({merged(d)}) x) m JOIN ({s}) s ON m.doc_id = s.doc_id AND m.bucket = s.bucket AND m.char_start >= s.char_start AND m.char_start < s.char_end"


@plan
def w4_sentence_offsets(d):
    return f"SELECT p.doc_id, p.paragraph_id, s.sentence_id, s.char_start - p.char_start AS in_paragraph FROM ({paragraphs(d)}) p JOIN ({sentences(d)}) s ON p.doc_id = s.doc_id AND p.paragraph_id = s.paragraph_id"


@plan
def w2_reference_flag(d):
    return f"SELECT doc_id, {d.long("count_if(block_type = 'reference')")} AS n_references FROM ({classified(d)}) c GROUP BY doc_id"


@plan
def p24_issue_filter(d):
    return f"SELECT doc_id, grp FROM ({merged(d)}) m WHERE confidence >= 0.5 AND ({d.contains('lower(text)', d.text('ent'))} OR {d.contains('lower(suggestion)', d.text('ent'))}) AND issue_type IN ('style', 'punctuation')"


@plan
def p25_issue_search(d):
    return f"SELECT doc_id, grp, issue_type FROM ({merged(d)}) m WHERE {d.contains('lower(text)', d.text('sch'))}"


@plan
def p27_documents_by_name(d):
    return f"SELECT doc_id FROM documents WHERE {d.contains('lower(source)', d.text('src1'))}"


@plan
def p29_issue_normaliser(d):
    i = rows((None, 0, None), ("x", 3, "high"), (None, 2, "low"), names="issue_id, page, severity")
    every = f"SELECT -1 AS doc_id, issue_id, page, severity FROM {i} i UNION ALL SELECT doc_id, CASE WHEN rule_ = 0 THEN NULL ELSE issue_id END, page - rule_, CASE WHEN rule_ = 0 THEN NULL ELSE severity END FROM (SELECT *, page % 2 AS rule_ FROM {ambiguities(d)} a) b"
    n = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, coalesce(severity, ''), coalesce(issue_id, '')) AS ord FROM ({every}) i"
    return f"SELECT doc_id, coalesce(issue_id, concat('issue_', ord)) AS issue_id, greatest(page, 1) AS page, coalesce(severity, 'medium') AS severity FROM ({n}) x"


@plan
def p30_object_types(d):
    return f"SELECT doc_id, element_id, CASE WHEN kind = 'heading' THEN 'Heading' WHEN kind = 'list' AND {d.like('text', '[*-]')} THEN 'Bullet List' WHEN kind = 'list' THEN 'List' WHEN kind = 'code' THEN 'Code Block' WHEN kind = 'caption' THEN 'Caption' WHEN kind = 'table' THEN 'Table' WHEN kind = 'picture' THEN 'Image' ELSE 'Paragraph' END AS object_type FROM {elements(d)} e"


@plan
def s9_elements(d):
    return f"SELECT e.doc_id, e.element_id, e.kind, c.text AS caption FROM {elements(d)} e LEFT JOIN {elements(d)} c ON e.doc_id = c.doc_id AND e.caption_id = c.element_id"


@plan
def j27_caption_targets(d):
    return f"SELECT c.doc_id, c.element_id AS caption_id, e.element_id AS target_id FROM {elements(d)} c JOIN {elements(d)} e ON e.doc_id = c.doc_id AND e.caption_id = c.element_id"


@plan
def d11_typed_objects(d):
    """One object for an element; a table gives one more for each cell, an image one for its description."""
    every = f"SELECT doc_id, 0 AS part, element_id, 0 AS sub, kind AS what, text FROM {elements(d)} e UNION ALL SELECT doc_id, 1, table_id, {d.int('row_no * 1000 + col_no')}, 'cell', text FROM {cells(d)} c UNION ALL SELECT doc_id, 0, element_id, 1, 'description', description FROM {elements(d)} x WHERE description IS NOT NULL"
    return f"SELECT doc_id, {d.int('row_number() OVER (PARTITION BY doc_id ORDER BY part, element_id, sub)')} AS seq, what, text FROM ({every}) o"


@plan
def s11_table_size(d):
    return f"SELECT doc_id, table_id, max(row_no + row_span) AS n_rows, max(col_no + col_span) AS n_cols FROM {cells(d)} c GROUP BY doc_id, table_id"


@plan
def s15_description_parser(d):
    i = f"(SELECT image, answer FROM {rows((-1, 'Type: chart' + chr(10) + 'Description: sales by year' + chr(10) + 'Objects: bar, axis'), (-2, 'no fields'), names='image, answer')} v UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations)"
    field = lambda name: f"nullif({d.extract('answer', name + ': ([^' + chr(10) + ']*)', 1)}, '')"
    return f"SELECT image, coalesce({field('Type')}, 'image') AS kind, coalesce({field('Description')}, answer) AS description, {field('Objects')} AS objects FROM {i} i"


@plan
def s20_collection_names(d):
    return f"SELECT doc_id, concat('doc_', substr({d.sub('lower(concat(source, chr(95), lang))', '[^a-z0-9_-]', '_')}, 1, 42), '_', substr(md5(text), 1, 16)) AS name FROM documents"


@plan
def j7_entity_index(d):
    q = rows((1, "what does Acme pay"), (2, "the fee of Bolt"), names="query_id, query")
    return f"SELECT DISTINCT q.query_id, e.chunk_id FROM {q} q JOIN {entities(d)} e ON {d.contains('lower(q.query)', 'lower(e.text)')}"


@plan
def j8_heading_match(d):
    q = rows((1, "scope of the introduction"), (2, "results"), names="query_id, query")
    return f"SELECT q.query_id, o.knowledge_id FROM {q} q JOIN {objects(d)} o ON {d.extract('o.heading', '[A-Za-z]+', 0)} <> '' AND {d.contains('q.query', 'lower(' + d.extract('o.heading', '[A-Za-z]+', 0) + ')')}"


@plan
def j10_fill_candidates(d):
    hit = top(bm25(d), "query_id", "score DESC, doc_id", 5)
    more = "SELECT 1 AS query_id, doc_id FROM documents WHERE source = 'src1' AND lang = 'en'"  # what the metadata filter finds
    return f"SELECT query_id, doc_id, score FROM ({hit}) h UNION ALL SELECT m.query_id, m.doc_id, CAST(0.01 AS DOUBLE) FROM ({more}) m LEFT JOIN ({hit}) h ON m.query_id = h.query_id AND m.doc_id = h.doc_id WHERE h.doc_id IS NULL"


@plan
def j13_cluster_context(d):
    return f"SELECT k.cluster_id, k.chunk_id, c.claim_id, a.issue_id FROM {chunks(d)} k LEFT JOIN {claims(d)} c ON k.chunk_id = c.chunk_id LEFT JOIN {ambiguities(d)} a ON k.chunk_id = a.chunk_id"


@plan
def j14_validated_claims(d):
    v = f"(SELECT claim_id, status FROM ({f36_claim_status(d)}) s UNION ALL SELECT 'gone', 'partial')"
    return f"SELECT v.claim_id, v.status, coalesce(c.text, 'N/A') AS original FROM {v} v LEFT JOIN {claims(d)} c ON v.claim_id = c.claim_id"


@plan
def j15_entity_claim(d):
    """The first claim of an entity's chunk that names it, else the chunk's first claim."""
    best = f"SELECT e.entity_id, c.claim_id, row_number() OVER (PARTITION BY e.entity_id ORDER BY CASE WHEN {d.contains('c.text', 'e.text')} THEN 0 ELSE 1 END, c.claim_id) AS rn FROM {entities(d)} e LEFT JOIN {claims(d)} c ON e.chunk_id = c.chunk_id"
    return f"SELECT entity_id, claim_id FROM ({best}) b WHERE rn = 1"


@plan
def j16_affected_claims(d):
    return f"SELECT a.issue_id, {d.strings('c.claim_id', ',', 'c.claim_id')} AS claims FROM {ambiguities(d)} a JOIN {claims(d)} c ON a.chunk_id = c.chunk_id AND {d.contains('c.text', 'a.quote')} GROUP BY a.issue_id"


@plan
def j17_evidence_pages(d):
    return f"SELECT a.issue_id, a.quote, k.page FROM {ambiguities(d)} a LEFT JOIN {chunks(d)} k ON a.chunk_id = k.chunk_id"


@plan
def j18_side_by_side(d):
    """Issues over two objects: neighbours under one heading, and one whose second object is gone."""
    pairs = f"SELECT doc_id, knowledge_id AS a, lead(knowledge_id) OVER (PARTITION BY doc_id, heading ORDER BY knowledge_id) AS b FROM {objects(d)} o"
    i = f"(SELECT a AS issue, a, coalesce(b, 'gone') AS b FROM ({pairs}) p)"
    return f"SELECT i.issue, x.text AS left_text, y.text AS right_text FROM {i} i LEFT JOIN {objects(d)} x ON i.a = x.knowledge_id LEFT JOIN {objects(d)} y ON i.b = y.knowledge_id"


@plan
def j19_unverified(d):
    """Pairs that a search proposes and that aren't, in either order, among the verified ones."""
    a, b = f"(SELECT query_id AS x, vec_id AS y FROM ({neighbours(d)}) n)", f"(SELECT b AS x, a AS y FROM ({edges(d)}) e WHERE similarity >= 0.3)"
    return f"SELECT a.x, a.y FROM {a} a LEFT JOIN {b} b ON least(a.x, a.y) = least(b.x, b.y) AND greatest(a.x, a.y) = greatest(b.x, b.y) WHERE b.x IS NULL"


@plan
def j20_package(d):
    return f"SELECT k.doc_id, k.cluster_id, count(DISTINCT k.chunk_id) AS n_chunks, count(DISTINCT c.claim_id) AS n_claims, count(DISTINCT a.issue_id) AS n_issues FROM {chunks(d)} k LEFT JOIN {claims(d)} c ON k.chunk_id = c.chunk_id LEFT JOIN {ambiguities(d)} a ON k.chunk_id = a.chunk_id GROUP BY k.doc_id, k.cluster_id"


@plan
def p21_cited_objects_exist(d):
    """Answers that cite at least one object that there is; each document's answer cites its sixth block and one more."""
    more = rows((-1, "k1"), (-1, "zz"), (-2, "yy"), names="answer, knowledge_id")
    cite = f"(SELECT answer, knowledge_id FROM {more} m UNION ALL SELECT doc_id, concat({d.string('doc_id')}, '_000005') FROM documents UNION ALL SELECT doc_id, concat({d.string('doc_id')}, '_999999') FROM documents)"
    return f"SELECT c.answer, count(o.knowledge_id) > 0 AS is_cited FROM {cite} c LEFT JOIN {objects(d)} o ON c.knowledge_id = o.knowledge_id GROUP BY c.answer"


@plan
def p20_verified(d):
    return f"SELECT issue_id FROM {ambiguities(d)} a WHERE confidence >= 0.4 AND kind <> 'none'"


# Words that make a block worth a model's reading.
TRIGGERS = ("must", "shall", "will", "agree", "policy", "section", "claim", "require", "mandatory", "guarantee", "indemnify", "liability", "term", "contract", "specifications", "schedule")


@plan
def p19_model_eligible(d):
    """Blocks of 45 words or more that are no table, heading, header or footer and hold a trigger word; one of a fixture too."""
    own = rows((-1, 0, "paragraph", "The supplier shall deliver " + "goods in time " * 15), (-1, 1, "paragraph", "The supplier shall deliver"), (-1, 2, "table", "must " * 50), (-1, 3, "paragraph", "plain words " * 30), names="doc_id, block_id, block_type, text")
    every = f"SELECT doc_id, block_id, block_type, text FROM ({classified(d)}) c UNION ALL SELECT doc_id, block_id, block_type, text FROM {own} o"
    n = d.size(d.keep(d.split("text", r"\s+"), "w", "w <> ''"))
    return f"SELECT doc_id, block_id FROM ({every}) c WHERE block_type NOT IN ('table', 'heading', 'header', 'footer') AND {n} >= 45 AND ({' OR '.join(d.contains('lower(text)', d.text(w)) for w in TRIGGERS)})"


@plan
def p6_semantic_gate(d):
    """Issues that keep the meaning and are better, by the offline rules: little is cut off, and something changes."""
    c = f"SELECT doc_id, grp, 2 * length(suggestion) >= length(text) AS keeps_meaning, suggestion <> text AS is_better FROM ({merged(d)}) m"
    return f"SELECT doc_id, grp FROM ({c}) c WHERE keeps_meaning AND is_better"


@plan
def p23_domain_terms(d):
    t = f"(SELECT term FROM {rows(('chunks',), ('vector index',), ('banana',), names='term')} v UNION SELECT term FROM benchmark {d.each(words(d, 'text'), 'term', 'pos')})"
    return f"SELECT term, {d.sub('term', 's$', '')} IN ('chunk', 'vector', 'index') OR {d.contains('term', d.text('index'))} AS is_domain FROM {t} t"


@plan
def p31_download_allowed(d):
    f = f"(SELECT -1 AS page_id, name FROM {rows(('report.json',), ('../etc',), ('summary.csv',), names='name')} v UNION ALL SELECT page_id, {d.extract('url', '([^/?#]*)(?:[?#].*)?$', 1)} FROM pages)"
    return f"SELECT page_id, name FROM {f} f WHERE name IN ('report.json', 'summary.csv', 'report.md')"


@plan
def j26_accepted_issues(d):
    return f"SELECT doc_id, grp FROM ({decided(d)}) m WHERE decision = 'accepted'"


@plan
def a9_claim_totals(d):
    return f"SELECT (SELECT count(*) FROM {claims(d)} c) AS claims, (SELECT count(*) FROM {entities(d)} e) AS entities, (SELECT round(avg(confidence), 6) FROM {ambiguities(d)} a) AS mean_confidence"


@plan
def a10_risk_histogram(d):
    return f"SELECT CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS risk, count(*) AS n FROM {ambiguities(d)} a GROUP BY CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END"


@plan
def a11_cluster_severity(d):
    return f"SELECT k.doc_id, k.cluster_id, count(*) AS n, max(a.confidence) AS worst FROM {ambiguities(d)} a JOIN {chunks(d)} k ON a.chunk_id = k.chunk_id GROUP BY k.doc_id, k.cluster_id"


@plan
def a7_cluster_statistics(d):
    """Sizes of clusters (labels) and the mean similarity of the edges inside each, with a default where there is none."""
    inside = f"SELECT x.label, e.similarity FROM ({edges(d)}) e JOIN embeddings x ON e.a = x.vec_id JOIN embeddings y ON e.b = y.vec_id AND x.label = y.label"
    means = f"SELECT label, avg(similarity) AS mean, count(*) AS n_edges FROM ({inside}) i GROUP BY label"
    return f"SELECT v.label, v.size, round(coalesce(m.mean, 0.72), 5) AS mean_similarity, coalesce(m.n_edges, 0) AS n_edges FROM (SELECT label, count(*) AS size FROM embeddings GROUP BY label) v LEFT JOIN ({means}) m ON v.label = m.label"


@plan
def a43_issue_pills(d):
    return f"SELECT count(*) AS every_issue, {d.long('count_if(is_protected)')} AS protected, {d.long('count_if(confidence > 0.8)')} AS sure FROM ({merged(d)}) m"


@plan
def a26_document_risk(d):
    return f"SELECT doc_id, CASE WHEN max(CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) >= 2 THEN 'High' WHEN count(*) > 5 THEN 'Medium' ELSE 'Low' END AS risk FROM ({merged(d)}) m GROUP BY doc_id"


@plan
def o1_issues_by_start(d):
    return f"SELECT doc_id, grp, {d.int('row_number() OVER (PARTITION BY doc_id ORDER BY char_start, grp)')} AS place FROM ({merged(d)}) m"


@plan
def o2_right_to_left(d):
    return f"SELECT doc_id, grp, {d.int('row_number() OVER (PARTITION BY doc_id ORDER BY char_start DESC, grp DESC)')} AS step FROM ({merged(d)}) m"


@placed("cluster_no", "n DESC", "label")
def o9_clusters_by_size(d):
    return "SELECT label, count(*) AS n FROM embeddings GROUP BY label"


@plan
def o11_first_of_each(d):
    return f"SELECT doc_id, source, grp FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source ORDER BY char_start, grp) AS rn FROM ({merged(d)}) m) x WHERE rn <= 2"


@plan
def o15_issue_sorts(d):
    return f"SELECT doc_id, grp, {d.int('row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, grp)')} AS by_confidence, {d.int('row_number() OVER (PARTITION BY doc_id ORDER BY lower(text), grp)')} AS by_text FROM (SELECT * FROM ({merged(d)}) a WHERE {d.like('text', '^[a-zA-Z!]+$')}) m"


def o16_sql(d):
    """Documents by their four sorts: newest first, by name, by the number of issues, by length."""
    n = f"SELECT t.doc_id, concat(t.source, '/', t.doc_id) AS name, t.n_chars, coalesce(m.n, 0) AS n FROM documents t LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({merged(d)}) m GROUP BY doc_id) m ON t.doc_id = m.doc_id"
    place = lambda order: d.int(f"row_number() OVER (ORDER BY {order})")
    return f"SELECT doc_id, {place('doc_id DESC')} AS by_newest, {place('name')} AS by_name, {place('n DESC, doc_id')} AS by_issues, {place('n_chars DESC, doc_id')} AS by_length FROM ({n}) x"


@frame(o16_sql)
def o16_document_sorts(spark, sf_dir):
    issues = QUERIES["w6_merged_issues"](spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"), "n_chars")
    out = docs.join(issues, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    for name, *order in (("by_newest", F.col("doc_id").desc()), ("by_name", F.col("name")), ("by_issues", F.col("n").desc(), F.col("doc_id")), ("by_length", F.col("n_chars").desc(), F.col("doc_id"))):
        out = ranking.places(out, name, *order)
    return out.select("doc_id", "by_newest", "by_name", "by_issues", "by_length")


@plan
def u5_rewrites(d):
    return f"SELECT claim_id AS id, 'claim' AS kind FROM {claims(d)} c UNION ALL SELECT issue_id, 'ambiguity' FROM {ambiguities(d)} a"


@plan
def u10_shared_words(d):
    """Words that a question shares with each document found for it, and whether it has all of the question's."""
    a, b = d.distinct(words(d, "query")), d.distinct(words(d, "text"))
    return f"SELECT query_id, doc_id, {d.int(d.size(d.both(a, b)))} AS shared, {d.size(d.minus(a, b))} = 0 AS has_all FROM ({search_pairs(d)}) p"


@plan
def f35_vague_words(d):
    return f"SELECT issue_id, kind, severity, confidence, quote, evidence, rewrite FROM {ambiguities(d)} a"


@plan
def f35_chunk_risk(d):
    """The first two ambiguities of each chunk count; the risk is of their number."""
    two = top(f"SELECT chunk_id, issue_id FROM {ambiguities(d)} a WHERE confidence >= 0.7", "chunk_id", "issue_id", 2)
    return f"SELECT k.chunk_id, count(t.issue_id) AS n, CASE WHEN count(t.issue_id) >= 3 THEN 'High' WHEN count(t.issue_id) > 0 THEN 'Medium' ELSE 'Low' END AS risk FROM {chunks(d)} k LEFT JOIN ({two}) t ON k.chunk_id = t.chunk_id GROUP BY k.chunk_id"


@plan
def f38_date_statements(d):
    return f"SELECT knowledge_id, {d.extract('text', '(?i)(effective|start|end) date is ([0-9-]+)', 2)} AS value FROM {objects(d)} o WHERE {d.like('text', '(?i)(effective|start|end) date is [0-9-]+')}"


@plan
def f41_heading_numbers(d):
    return f"SELECT knowledge_id, CAST({d.at(d.split(d.extract('heading', '^[0-9.]+', 0), '[.]'), '0')} AS INT) AS major, CAST({d.at(d.split(d.extract('heading', '^[0-9.]+', 0), '[.]'), '1')} AS INT) AS minor FROM {objects(d)} o WHERE {d.like('heading', '^[0-9]+[.][0-9]+')}"


@plan
def f42_source_confidence(d):
    return f"SELECT source, issue_type, agreement, count(*) AS n, min(confidence) AS low, max(confidence) AS high FROM ({merged(d)}) m GROUP BY source, issue_type, agreement"


@plan
def d13_model_routes(d):
    m = rows(("grammar", "small"), ("vision", "large"), names="task, model")
    t = rows(("grammar",), ("other",), names="task")
    return f"SELECT t.task, coalesce(m.model, 'default') AS model FROM {t} t LEFT JOIN {m} m ON t.task = m.task"


@plan
def s22_whitelist(d):
    """Candidates of words that a list of allowed words holds."""
    w = rows(("mit",), ("license",), ("enlichschpf",), names="word")
    return f"SELECT c.doc_id, c.ord FROM ({gated(d)}) c JOIN {w} w ON lower(c.text) = w.word"


@plan
def s24_report_rows(d):
    return f"SELECT doc_id, concat_ws(',', CAST(grp AS STRING), issue_type, severity) AS csv_row FROM ({merged(d)}) m" if d.__class__.__name__ == "SparkSql" else f"SELECT doc_id, concat_ws(',', CAST(grp AS VARCHAR), issue_type, severity) AS csv_row FROM ({merged(d)}) m"


@plan
def w19_first_occurrence(d):
    """For each document the first one of the same text, found by digests."""
    return "SELECT d.doc_id, f.first_id FROM (SELECT doc_id, md5(text) AS digest FROM documents) d JOIN (SELECT md5(text) AS digest, min(doc_id) AS first_id FROM documents GROUP BY md5(text)) f ON d.digest = f.digest"


@plan
def a12_package_size(d):
    return f"SELECT finding_id, {d.int(d.size(words(d, 'concat(title, chr(32), quote)')))} AS n_words FROM ({scored(d)}) s"


@plan
def a8_topic_labels(d):
    """A label for each source: its main language, then its two most frequent longer words."""
    n = f"SELECT source, term, count(*) AS n FROM documents {d.each(words(d, 'text'), 'term', 'pos')} WHERE {d.like('term', '^[a-z]{6,}$')} GROUP BY source, term"
    two = f"SELECT source, {d.strings('term', ' & ', 'rnk')} AS label FROM ({top(n, 'source', 'n DESC, term', 2)}) k GROUP BY source"
    lang = "SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rn FROM documents GROUP BY source, lang) l WHERE rn = 1"
    return f"SELECT t.source, concat(l.lang, ' & ', t.label) AS label FROM ({two}) t JOIN ({lang}) l ON t.source = l.source"


@plan
def a15_executive_groups(d):
    return f"SELECT doc_id, category, substr(explanation, 1, 50) AS topic, max(risk_score) AS risk, count(*) AS n, {d.strings('section', '; ', 'finding_id')} AS sections FROM ({scored(d)}) s GROUP BY doc_id, category, substr(explanation, 1, 50)"


def boosted(d) -> str:
    """Fused ranks with boosts where a question asks for what a document's chunks name."""
    query = rows(*SEARCHES, names="query_id, query")
    meta = f"SELECT k.doc_id, max(CASE WHEN {d.like('k.text', TABLE_ROW)} THEN 1 ELSE 0 END) AS tables, max(CASE WHEN e.people <> '' THEN 1 ELSE 0 END) AS people, max(CASE WHEN e.places <> '' THEN 1 ELSE 0 END) AS places, max(CASE WHEN e.dates <> '' THEN 1 ELSE 0 END) AS dates, max(e.report) AS report FROM {chunks(d)} k JOIN ({f29_chunk_enrichment(d)}) e ON k.chunk_id = e.chunk_id GROUP BY k.doc_id"
    asks = lambda *words_: "(" + " OR ".join(d.contains("q.query", d.text(w)) for w in words_) + ")"
    # Words of a question, what they ask for, and the boost.
    rules = ((asks("table"), "m.tables = 1", 0.3), (asks("people", "person", "who", "names"), "m.people = 1", 0.2), (asks("location", "where", "place", "state", "region", "district", "country"), "m.places = 1", 0.2), (asks("date", "when", "year", "month", "timeline", "chronology"), "m.dates = 1", 0.2), (f"{d.extract('q.query', 'report ([0-9]+)', 1)} <> ''", f"m.report = {d.extract('q.query', 'report ([0-9]+)', 1)}", 0.5))
    boost = " + ".join(f"CASE WHEN {a} AND {b} THEN {n} ELSE 0 END" for a, b, n in rules)
    return f"SELECT f.query_id, f.doc_id, q.query, round(f.rrf + {boost}, 6) * CAST(1 AS DOUBLE) AS score FROM ({fused(d)}) f JOIN {query} q ON q.query_id = f.query_id LEFT JOIN ({meta}) m ON m.doc_id = f.doc_id"


@plan
def f46_boosted(d):
    return f"SELECT query_id, doc_id, score FROM ({boosted(d)}) b"


@plan
def o5_rank_chain(d):
    """Depths in a row: boosted fused ranks, the best fifteen of these by the words shared, the best eight at last."""
    shared = d.int(d.size(d.both(d.distinct(words(d, "query")), d.distinct(words(d, "t.text")))))
    rerank = f"SELECT b.query_id, b.doc_id, b.score, {shared} AS shared FROM ({top(boosted(d), 'query_id', 'score DESC, doc_id', 15)}) b JOIN documents t ON t.doc_id = b.doc_id"
    return f"SELECT query_id, doc_id, rnk FROM ({top(rerank, 'query_id', 'shared DESC, score DESC, doc_id', 8)}) r"


@plan
def o7_document_order(d):
    c = f"(SELECT doc_id, chunk_id, page FROM {chunks(d)} k)"
    return f"SELECT chunk_id, {d.int('row_number() OVER (PARTITION BY doc_id ORDER BY page, CAST(' + d.extract('chunk_id', '_chunk_([0-9]+)', 1) + ' AS INT))')} AS place FROM {c} c"


@plan
def o10_edges_by_similarity(d):
    return f"SELECT query_id, vec_id, {d.int('row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)')} AS place FROM ({neighbours(d)}) n"


@plan
def o13_capped_lists(d):
    return f"SELECT source, {d.strings('doc_id', ',', 'doc_id') if d.__class__.__name__ == 'DuckSql' else d.strings('CAST(doc_id AS STRING)', ',', 'doc_id')} AS first_ids FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) x WHERE rn <= 4 GROUP BY source"


@plan
def o17_finding_sorts(d):
    return f"SELECT finding_id, {d.int('row_number() OVER (PARTITION BY doc_id ORDER BY risk_score DESC, finding_id)')} AS by_risk, {d.int('row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, finding_id)')} AS by_confidence FROM ({scored(d)}) s"


@plan
def o18_entities_by_text(d):
    return f"SELECT entity_id, {d.int('row_number() OVER (PARTITION BY doc_id ORDER BY text, entity_id)')} AS place FROM {entities(d)} e"


@plan
def u4_candidate_union(d):
    """Candidates of two searches, once each, the first search first."""
    a, b = top(bm25(d), "query_id", "score DESC, doc_id", 10), "SELECT 1 AS query_id, doc_id FROM documents WHERE source = 'src0' AND lang = 'fr'"
    both = f"SELECT query_id, doc_id, 'words' AS found_by, 0 AS ord FROM ({a}) a UNION ALL SELECT query_id, doc_id, 'metadata', 1 FROM ({b}) b"
    return f"SELECT query_id, doc_id, min_by(found_by, ord) AS found_by FROM ({both}) u GROUP BY query_id, doc_id"


@plan
def u11_ordered_distinct(d):
    first = f"SELECT doc_id, term, min(pos) AS first FROM documents {d.each(words(d, 'text'), 'term', 'pos')} GROUP BY doc_id, term"
    return f"SELECT doc_id, md5({d.strings('term', ' ', 'first')}) AS digest FROM ({first}) f GROUP BY doc_id"


@placed("place", "created DESC", "job", drop="created")
def s27_jobs_newest_first(d):
    """Documents' folders as jobs, by the newest page of each."""
    return f"SELECT {d.extract('url', '^[a-z]+://([^/]+)', 1)} AS job, max(page_id) AS created FROM pages GROUP BY {d.extract('url', '^[a-z]+://([^/]+)', 1)}"


@plan
def s28_artifact_status(d):
    a = rows(("report", "report.json"), ("matrix", "matrix.json"), ("swot", "swot.json"), names="artifact, path")
    have = rows(("report.json", 120), ("matrix.json", 0), names="path, size")
    return f"SELECT a.artifact, CASE WHEN h.size > 0 THEN 'ready' WHEN h.size = 0 THEN 'generating' ELSE 'missing' END AS status FROM {a} a LEFT JOIN {have} h ON a.path = h.path"
