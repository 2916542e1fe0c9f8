"""Streams over stored events, ingest that is interrupted, and models that fail."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import models
from docspark.plans.dialect import frame
from docspark.streaming import ingest, jobs, page_batches

PAGE, BATCH, LIMIT, LEASE = 2000, 15, 20_000, 6 * 3600
#: Which of the table's events stand for which steps of a job.
STEPS = {"view": "put", "click": "beat", "signup": "beat", "purchase": "done", "error": "failed"}


def _events(spark, sf_dir, step):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("user_id").alias("job"), "event_id", "ts", step.alias("step"))


@frame(lambda d: "SELECT user_id AS job, event_id, ts, event_type AS step FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) e WHERE before IS NULL OR before <> event_type")
def x3_progress_stream(spark, sf_dir):
    """The events at which a job's type changes, emitted by keyed state over a stream of four batches."""
    return jobs.replay(spark, _events(spark, sf_dir, F.col("event_type")), jobs.progress, ingest.work_folder(spark))


def _queue(d) -> str:
    step = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STEPS.items()) + " END"
    lease, far = LEASE * 1_000_000, "epoch_us(TIMESTAMP '2199-01-01')"
    e = f"SELECT job, us, step, row_number() OVER (PARTITION BY job ORDER BY us, event_id) AS k FROM (SELECT user_id AS job, event_id, epoch_us(ts) AS us, {step} AS step FROM events UNION ALL SELECT DISTINCT user_id, 0, {far}, 'end' FROM events) u"
    # c: leases that run out before the event; of those all but the last one, if the job has had two, deal it again
    joined = f"SELECT e.job, e.k, e.us, e.step, r.running, r.attempt, r.beat, CASE WHEN r.running THEN least(greatest((e.us - r.beat - 1) // {lease}, 0), 3 - r.attempt) ELSE 0 END AS c FROM r JOIN e ON e.job = r.job AND e.k = r.k + 1"
    then = f"SELECT *, running AND c < 3 - attempt AS still, least(attempt + c, 2) AS tried, beat + c * {lease} AS last FROM ({joined}) j"
    return f"""WITH RECURSIVE e AS ({e}),
r(job, k, running, attempt, beat, c, a0, b0, us, action) AS (SELECT DISTINCT job, 0::BIGINT, false, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR FROM e
UNION ALL SELECT job, k, (still AND step NOT IN ('done', 'failed')) OR (NOT still AND step = 'put'), CASE WHEN NOT still AND step = 'put' THEN 1 ELSE tried END, CASE WHEN still AND step = 'beat' OR NOT still AND step = 'put' THEN us ELSE last END,
  c, attempt, beat, us, CASE WHEN NOT still AND step = 'put' THEN 'dealt' WHEN still AND step IN ('done', 'failed') THEN step END FROM ({then}) t)
SELECT job, make_timestamp(us) AS ts, action, attempt::INT AS attempt FROM r WHERE action IS NOT NULL
UNION ALL SELECT job, make_timestamp(b0 + i * {lease}), CASE WHEN a0 + i <= 2 THEN 'dealt again' ELSE 'given up' END, least(a0 + i, 2)::INT FROM (SELECT *, unnest(range(1, c + 1)) AS i FROM r) x"""


@frame(_queue)
def x2_work_queue(spark, sf_dir):
    """Jobs dealt out under leases of six hours: what the queue does as events come, or don't."""
    step = F.create_map(*[F.lit(x) for kv in STEPS.items() for x in kv])[F.col("event_type")]
    return jobs.replay(spark, _events(spark, sf_dir, step), lambda e: jobs.leases(e, LEASE), ingest.work_folder(spark))


def _lines(content: str) -> list[str]:
    if not any("a" <= c <= "z" for c in content):
        raise ValueError("no text")
    return [x for x in content.split("\n") if x]


def _ingested(d) -> str:
    pages = f"SELECT doc_id, p + 1 AS page, substr(text, p * {PAGE} + 1, {PAGE}) AS content FROM (SELECT doc_id, text, unnest(range(0, (length(text) + {PAGE - 1}) // {PAGE})) AS p FROM documents) q"
    bad = "NOT regexp_matches(content, '[a-z]')"
    lines = f"SELECT doc_id, page, unnest(string_split(content, chr(10))) AS text, unnest(range(0, len(string_split(content, chr(10))))) AS pos FROM ({pages}) p WHERE NOT {bad}"
    batch = f"((page - 1) // {BATCH})"
    return f"SELECT doc_id, concat('b', {batch}, '_', row_number() OVER (PARTITION BY doc_id, {batch} ORDER BY page, pos) - 1) AS element_id, page::INT AS page, text, NULL AS error FROM ({lines}) l WHERE text <> '' UNION ALL SELECT doc_id, NULL, page::INT, NULL, 'no text' FROM ({pages}) p WHERE {bad}"


@frame(_ingested)
def x1_resumed_ingest(spark, sf_dir):
    """Lines of documents, ingested in batches of fifteen pages of 2,000 characters; the first run stops after three of eight rounds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.ceil(F.length("text") / PAGE).cast("int")
    pages = docs.where("text <> ''").select("doc_id", "text", F.explode(F.sequence(F.lit(1), n)).alias("page"))
    pages = pages.select("doc_id", "page", F.substring("text", (F.col("page") - 1) * PAGE + 1, F.lit(PAGE)).alias("content"))
    folder = f"{ingest.work_folder(spark)}/rounds"
    page_batches.ingest(pages, _lines, folder, BATCH, most=3)
    page_batches.ingest(pages, _lines, folder, BATCH)
    return page_batches.merged(spark, folder)


@frame(lambda d: f"SELECT doc_id, CASE WHEN length(text) <= {LIMIT} THEN len(list_filter(range(1, len(string_split(text, ' '))), lambda i: string_split(text, ' ')[i] = string_split(text, ' ')[i + 1] AND string_split(text, ' ')[i] <> '')) END AS n_doubled, CASE WHEN length(text) > {LIMIT} THEN 'text too long' END AS error FROM documents")
def x6_model_calls(spark, sf_dir):
    """A review of all documents by a model that refuses long ones, in batches: only those that it refuses have errors."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = models.called(docs, "text", [models.doubled_words(LIMIT)], "long", models.Calls(tries=2, wait=0.0))
    return out.select("doc_id", F.col("result").alias("n_doubled"), "error")
