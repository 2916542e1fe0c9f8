"""Jobs, stages, progress and decisions, event-sourced from the events table; and small reports over the corpus."""

from __future__ import annotations

from docspark.plans.dialect import placed, plan, rows

STAGES = ("view", "click", "cart", "purchase")


@plan
def a34_dashboard(d):
    """Documents as jobs: how many, their mean score (100 less an issue each, 45 at least, the fraction cut off; 86 without jobs), all issues, and the jobs of the last day."""
    from docspark.plans.spans import merged

    issues = f"SELECT doc_id, count(*) AS n FROM ({merged(d)}) m GROUP BY doc_id"
    jobs = f"SELECT count(*) AS jobs, {d.int('coalesce(floor(avg(greatest(45, 100 - coalesce(n, 0)))), 86)')} AS mean_score, {d.long('coalesce(sum(n), 0)')} AS issues FROM documents t LEFT JOIN ({issues}) i ON t.doc_id = i.doc_id"
    today = f"SELECT {d.long('count_if(CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events))')} AS today FROM (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id) e"
    return f"SELECT * FROM ({jobs}) j CROSS JOIN ({today}) t"


@plan
def a35_decision_counts(d):
    """Accepted and rejected issues of each document, and those without a decision."""
    from docspark.plans.spans import decided

    return f"SELECT doc_id, {', '.join(d.long(f'count_if(decision = {d.text(x)})') + f' AS {x}' for x in ('accepted', 'rejected', 'pending'))} FROM ({decided(d)}) m GROUP BY doc_id"


@plan
def a39_stage_progress(d):
    return "SELECT user_id, 100.0 * count(DISTINCT event_type) / 8 * CAST(1 AS DOUBLE) AS pct FROM events GROUP BY user_id"


@plan
def x7_latest_stage(d):
    """The latest event of each job and stage; ties by event_id."""
    return "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) e WHERE rn = 1"


@plan
def x7_stage_states(d):
    """Each job's stages: running one again resets the stages after it, which are then pending until they have run again."""
    at = "CASE event_type " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STAGES)) + " END"
    last = f"SELECT user_id, event_type, {at} AS no, max(ts) AS ts FROM events WHERE {at} IS NOT NULL GROUP BY user_id, event_type"
    before = "max(ts) OVER (PARTITION BY user_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"SELECT user_id, event_type, CASE WHEN ts < {before} THEN 'pending' ELSE 'complete' END AS state FROM ({last}) l"


@plan
def w17_emit_on_change(d):
    return "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) e WHERE before IS NULL OR before <> event_type"


@plan
def w18_eta(d):
    """After each event of a job, of those that there are: seconds since its first, and those that are left at the pace so far; null at the first."""
    w = "PARTITION BY user_id ORDER BY ts, event_id"
    done, elapsed = f"row_number() OVER ({w})", f"{d.seconds('ts')} - {d.seconds(f'first_value(ts) OVER ({w})')}"
    each = f"SELECT user_id, event_id, {done} - 1 AS done, count(*) OVER (PARTITION BY user_id) - {done} AS n_left, {elapsed} AS elapsed FROM events"
    label = f"CASE WHEN done = 0 THEN 'Estimating...' WHEN eta > 60 THEN concat({d.string(d.long('floor(eta / 60)'))}, 'm ', {d.string('eta % 60')}, 's') ELSE concat({d.string('eta')}, 's') END"
    eta = f"SELECT *, CASE WHEN done > 0 THEN {d.long('floor(elapsed / done * n_left)')} END AS eta FROM ({each}) e"
    return f"SELECT user_id, event_id, {d.int('n_left')} AS n_left, CAST(eta AS DOUBLE) AS eta, {label} AS label FROM ({eta}) x"


@placed("place", "newest DESC", "user_id")
def o14_newest_jobs(d):
    return "SELECT user_id, max(ts) AS newest FROM events GROUP BY user_id"


@plan
def x4_log_stages(d):
    log = f"(SELECT line, text FROM {rows((-1, 'Preprocessing started'), (-2, 'Splitting sentences'), (-3, 'Merging issues'), (-4, 'other'), names='line, text')} v UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations)"
    rules = (("preprocess", "preprocessing", 20), ("sentence", "sentences", 40), ("merg", "merge", 80))
    stage = " ".join(f"WHEN {d.contains('lower(text)', d.text(k))} THEN '{s}'" for k, s, _ in rules)
    pct = " ".join(f"WHEN {d.contains('lower(text)', d.text(k))} THEN {p}" for k, _, p in rules)
    return f"SELECT line, CASE {stage} ELSE 'unknown' END AS stage, CASE {pct} ELSE 0 END AS pct FROM {log} l"


@plan
def u12_latest_upload(d):
    up = f"(SELECT filename, job, no FROM {rows(('a.pdf', -1, 10), ('a.pdf', -2, 20), ('b.txt', -3, 5), names='filename, job, no')} v UNION ALL SELECT {d.extract('url', '([^/?#]*)(?:[?#].*)?$', 1)}, page_id, page_id FROM pages)"
    return f"SELECT filename, max_by(job, no) AS job FROM {up} u GROUP BY filename"


@plan
def s2_type_guard(d):
    f = f"(SELECT path FROM {rows(('a.PDF',), ('b.docx',), ('c.txt',), ('d.exe',), ('noext',), names='path')} v UNION ALL SELECT url FROM pages)"
    ext = "lower(" + d.extract("path", r"\.([A-Za-z0-9]+)$", 1) + ")"
    return f"SELECT path, {ext} IN ('pdf', 'docx', 'txt') AS supported FROM {f} f"


@plan
def s13_image_filter(d):
    i = rows((1, 100, 300, 20000), (2, 130, 130, 20000), (3, 300, 300, 5000), (4, 200, 100, 9000), (5, 130, 110, 9000), names="image, w, h, bytes")
    return f"SELECT image, w < 120 OR h < 120 OR w * h < 15000 OR bytes < 8192 AS decorative FROM {i} i"


@plan
def s10_ancestor_path(d):
    """Paths from the root over parents, at most fifty steps."""
    tree = "SELECT concat('r', {0}) AS id, CAST(NULL AS {2}) AS parent, r_name AS name FROM region UNION ALL SELECT concat('n', {1}), concat('r', n_regionkey), n_name FROM nation UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), s_name FROM supplier"
    string = "STRING" if d.__class__.__name__ == "SparkSql" else "VARCHAR"
    e = f"(SELECT id, parent, name FROM {rows(('1', None, 'Root'), ('2', '1', 'A'), ('3', '2', 'B'), ('4', '9', 'Lost'), names='id, parent, name')} v UNION ALL {tree.format('r_regionkey', 'n_nationkey', string)})"
    return f"WITH RECURSIVE t(id, path, depth) AS (SELECT id, CAST(name AS {string}), 0 FROM {e} r WHERE parent IS NULL UNION ALL SELECT c.id, CAST(concat(t.path, ' > ', c.name) AS {string}), t.depth + 1 FROM {e} c JOIN t ON c.parent = t.id WHERE t.depth < 50) SELECT id, path FROM t"


@plan
def s14_captions(d):
    from docspark.plans.derived import elements

    return f"SELECT a.doc_id, a.element_id, b.text AS caption FROM {elements(d)} a LEFT JOIN {elements(d)} b ON b.kind = 'caption' AND a.doc_id = b.doc_id AND a.caption_id = b.element_id WHERE a.kind IN ('picture', 'table')"


@plan
def s21_common_words(d):
    """A frequency dictionary of the corpus itself: words and whether they are common."""
    from docspark.plans.text import words

    return f"SELECT term, count(*) AS freq, count(*) > 100 AS is_common FROM documents {d.each(words(d, 'text'), 'term', 'pos')} GROUP BY term"


@plan
def u9_isolated(d):
    """Vectors that no edge of the similarity graph touches."""
    from docspark.plans.retrieval import edges

    return f"SELECT v.vec_id FROM embeddings v LEFT JOIN (SELECT a AS vec_id FROM ({edges(d)}) x UNION SELECT b FROM ({edges(d)}) y) c ON v.vec_id = c.vec_id WHERE c.vec_id IS NULL"


@plan
def a37_type_counts(d):
    return "SELECT label, count(*) AS n FROM embeddings GROUP BY label"


@plan
def a36_corpus_statistics(d):
    return f"SELECT count(*) AS docs, count(DISTINCT source) AS sources, max(doc_id) AS last_id, {d.long('sum(length(text))')} AS n_chars FROM documents"


@plan
def s29_content_key(d):
    return ("SELECT doc_id, sha2(text, 256) AS content_key FROM documents" if d.__class__.__name__ == "SparkSql" else "SELECT doc_id, sha256(text) AS content_key FROM documents")


@plan
def ext_tumbling_hours(d):
    """An extension, not one of the reference's operators: events by hour and type."""
    return f"SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY date_trunc('hour', ts), event_type"
