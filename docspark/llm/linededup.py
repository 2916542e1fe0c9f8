"""Line dedup by site-relative frequency: lines on too large a share of a host's pages are dropped.

A page's lines are its html without comments, scripts, styles and head, cut at block elements, tags removed, a few
character references decoded, white space collapsed. For each host, the pages that have a line are divided by the host's
pages; a line above ``ratio`` on at least ``least`` pages is boilerplate of that host and goes from all its pages.
A page counts once for a line. All of it is DataFrame functions.

A host has fewer boilerplate lines than its mean number of lines a page divided by ``ratio``, so they are one short array
for each host. Counts are partial before they are dealt out, so a line on every page of a hot host moves as one row for
each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import written

RATIO, LEAST = 0.1, 4
#: Hosts' arrays are broadcast up to this many lines in all (8 bytes each), joined by shuffle beyond.
BROADCAST_LINES = 500_000
# Patterns that Java's and RE2's expressions read alike.
CUT = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
BREAK = r"(?i)<(?:/?(?:address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*|br\s*/?)>"
TAG = r"<[^>]*>"
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def lines(html: F.Column) -> F.Column:
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"\s+", " ")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, CUT, " "), BREAK, "\n"), TAG, " ")
    for a, b in REFERENCES:
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.regexp_replace(text, r" +", " ")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def dedup(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """Rows ``(page_id, url, text, n_lines, n_dropped)``, one for each row of ``pages(page_id, url, html)``.

    ``text`` is the kept lines joined by newlines. The host is the url's, in small letters; rows whose url is null or has none
    share the empty host. A null or empty html has no lines. Repeated rows are pages of their own, and count.
    Pages of any length are read whole; other columns are left out.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    cut = written(pages.select("page_id", "url", host.alias("host"), lines(F.col("html")).alias("lines")), "lines")
    totals = cut.groupBy("host").agg(F.count("*").alias("pages"))
    counts = cut.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    common = counts.where(F.col("n") >= least).join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    common = written(common.groupBy("host").agg(F.collect_list("line").alias("common")), "common-lines")
    n = common.agg(F.sum(F.size("common"))).first()[0] or 0
    out = cut.join(F.broadcast(common) if n <= BROADCAST_LINES else common, "host", "left")
    kept = F.when(F.col("common").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("common", F.xxhash64(x))))
    out = out.withColumn("kept", kept)
    return out.select("page_id", "url", F.array_join("kept", "\n").alias("text"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size("kept")).alias("n_dropped"))


def oracle(ratio: float = RATIO, least: int = LEAST) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    text = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '\\s+', ' ', 'g'), {q(CUT)}, ' ', 'g'), {q(BREAK)}, chr(10), 'g'), {q(TAG)}, ' ', 'g')"
    for a, b in REFERENCES:
        text = f"replace({text}, {q(a)}, {q(b)})"
    return f"""
WITH c AS (SELECT row_number() OVER () AS rid, page_id, url, lower(regexp_extract(coalesce(url, ''), {q(HOST)}, 1)) AS host,
  list_filter(list_transform(string_split(regexp_replace({text}, ' +', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM pages),
t AS (SELECT host, count(*) AS pages FROM c GROUP BY host),
l AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM c) GROUP BY ALL),
b AS (SELECT host, list(line) AS common FROM l JOIN t USING (host) WHERE n >= {least} AND n > {ratio} * pages GROUP BY host),
k AS (SELECT rid, page_id, url, len(lines) AS n_lines, list_filter(lines, lambda x: NOT list_contains(coalesce(common, []), x)) AS kept FROM c LEFT JOIN b USING (host))
SELECT page_id, url, array_to_string(kept, chr(10)) AS text, CAST(n_lines AS INTEGER) AS n_lines, CAST(n_lines - len(kept) AS INTEGER) AS n_dropped FROM k
"""
