"""Retrieval: BM25, nearest vectors, fused ranks, keywords, conversation windows."""

from __future__ import annotations

from docspark.plans.dialect import SPARK, DuckSql, plan, rows, table, views
from docspark.plans.text import BODY, intent, words

QUERIES = ((1, "the license version"), (2, "public work released"), (3, "was not all rights"), (4, "and a reserved the"), (5, "zyglo"), (6, "who signed the table of report 17 in that year"), (7, "where is the work of the state"))
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Edges of the similarity graph have this cosine or more. The tables' vectors are unrelated; of real texts it is 0.75.
FLOOR = 0.2
# Words of five letters or more that are no keywords.
NO_KEYWORDS = "about above after again against because before being below between cannot could doing during further having herself himself itself myself other ought ourselves should their theirs themselves there these those through under until where which while would yours yourself yourselves document section content image table figure caption header footer".split()


def postings_sql(d) -> str:
    return f"SELECT doc_id, term, count(*) AS tf FROM documents {d.each(words(d, BODY), 'term', 'pos')} GROUP BY doc_id, term"


def postings(d) -> str:
    return d.stored("postings", postings_sql)


@table("postings")
def stored_postings(spark, sf_dir):
    """The index: a row for each document and term, with the document's length; documents are read once."""
    sql = f"SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, size(ws) AS len, ws FROM (SELECT doc_id, {words(SPARK, BODY)} AS ws FROM documents) w) x LATERAL VIEW explode(ws) t AS term GROUP BY doc_id, len, term"
    views(spark, sf_dir, sql)
    return spark.sql(sql)


def lengths(d) -> str:
    return f"SELECT doc_id, {d.size(words(d, BODY))} AS len FROM documents"


def idf(d) -> str:
    """Inverse document frequencies; negative ones are a quarter of the mean of all."""
    raw = f"SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM ({postings(d)}) p GROUP BY term) f CROSS JOIN (SELECT count(*) AS n FROM documents) a"
    return f"SELECT term, df, CASE WHEN idf < 0 THEN {EPSILON} * mean ELSE idf END AS idf FROM ({raw}) r CROSS JOIN (SELECT avg(idf) AS mean FROM ({raw}) m) x"


def bm25(d) -> str:
    query = rows(*QUERIES, names="query_id, query")
    asked = f"SELECT query_id, term FROM {query} q {d.each(words(d, 'query'), 'term', 'pos')}"
    score = lambda n: f"sum(i.idf * p.tf * ({K1} + 1) / (p.tf + {K1} * (1 - {B} + {B} * {n}.len / a.avgdl)))"
    if not isinstance(d, DuckSql):  # only the asked terms' postings go on; lengths are beside them
        mean = "SELECT (SELECT sum(tf) FROM postings) / (SELECT count(*) FROM documents) AS avgdl"
        return f"SELECT q.query_id, p.doc_id, round({score('p')}, 6) AS score FROM postings p JOIN ({asked}) q ON q.term = p.term JOIN ({idf(d)}) i ON i.term = p.term CROSS JOIN ({mean}) a GROUP BY q.query_id, p.doc_id"
    return f"""SELECT q.query_id, p.doc_id, round({score('l')}, 6) AS score FROM ({asked}) q JOIN ({postings(d)}) p ON q.term = p.term JOIN ({idf(d)}) i ON i.term = p.term
    JOIN ({lengths(d)}) l ON l.doc_id = p.doc_id CROSS JOIN (SELECT avg(len) AS avgdl FROM ({lengths(d)}) x) a GROUP BY q.query_id, p.doc_id"""


def search_pairs(d) -> str:
    """Each question with the documents that the search by words finds for it."""
    query = rows(*QUERIES, names="query_id, query")
    return f"SELECT h.query_id, q.query, t.doc_id, t.text FROM ({top(bm25(d), 'query_id', 'score DESC, doc_id', 10)}) h JOIN {query} q ON q.query_id = h.query_id JOIN documents t ON t.doc_id = h.doc_id"


def top(inner: str, by: str, order: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS INT) AS rnk FROM ({inner}) t) r WHERE rnk <= {k}"


def nearest_sql(d, who: str, k: int) -> str:
    """The nearest of all other vectors, written out as every pair: for the check only."""
    pairs = f"SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE {who}"
    return top(pairs, "query_id", "similarity DESC, vec_id", k)


def neighbours(d, k: int = 5) -> str:
    """For every vector whose id is divisible by 50, the nearest others."""
    return f"SELECT * FROM ({d.stored('vector_neighbours', lambda d: nearest_sql(d, 'q.vec_id % 50 = 0', 10))}) v WHERE rnk <= {k}"


def edges(d) -> str:
    """The undirected graph of all vectors' ten nearest others, at the floor."""
    n = lambda d: f"SELECT least(query_id, vec_id) AS a, greatest(query_id, vec_id) AS b, max(similarity) AS similarity FROM ({nearest_sql(d, 'true', 10)}) n WHERE similarity >= {FLOOR} GROUP BY least(query_id, vec_id), greatest(query_id, vec_id)"
    return d.stored("similarity_edges", n)


def fused(d) -> str:
    """Reciprocal ranks of the search by words and of the search by vectors, added up over a full outer join.

    A question's vector is the one with its number; a document's is the one with the document's.
    """
    a = top(bm25(d), "query_id", "score DESC, doc_id", 20)
    b = d.stored("question_neighbours", lambda d: nearest_sql(d, f"q.vec_id IN ({', '.join(str(q) for q, _ in QUERIES)})", 20))
    rank = lambda r: f"coalesce(CAST(1 AS DOUBLE) / (60 + {r}.rnk), 0)"
    return f"SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.vec_id) AS doc_id, round({rank('a')} + {rank('b')}, 6) AS rrf, coalesce(b.similarity, 0) AS similarity FROM ({a}) a FULL OUTER JOIN ({b}) b ON a.query_id = b.query_id AND a.doc_id = b.vec_id"


@plan
def a6_bm25_statistics(d):
    return f"SELECT term, df, round(idf, 6) AS idf FROM ({idf(d)}) i"


@plan
def f43_bm25_scores(d):
    return bm25(d)


@plan
def o3_bm25_top(d):
    return top(bm25(d), "query_id", "score DESC, doc_id", 10)


@plan
def o4_vector_top(d):
    return neighbours(d)


@plan
def f44_similarity_edges(d):
    return f"SELECT a, b, similarity FROM ({edges(d)}) e"


@plan
def j9_fused_ranks(d):
    return f"SELECT query_id, doc_id, rrf, similarity FROM ({fused(d)}) f"


@plan
def p11_metadata_filter(d):
    return "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'"


@plan
def a5_keywords(d):
    """A document's ten most frequent words of five or more plain letters, ties by first place."""
    stop = ", ".join(f"'{w}'" for w in NO_KEYWORDS)
    n = f"SELECT doc_id, term, count(*) AS n, min(pos) AS first FROM documents {d.each(words(d, 'text'), 'term', 'pos')} WHERE {d.like('term', '^[a-z]{5,}$')} AND term NOT IN ({stop}) GROUP BY doc_id, term"
    return f"SELECT doc_id, {d.strings('term', ' ', 'rnk')} AS keywords FROM ({top(n, 'doc_id', 'n DESC, first', 10)}) k GROUP BY doc_id"


@plan
def j11_neighbour_expansion(d):
    hit = top(bm25(d), "query_id", "score DESC, doc_id", 3)
    linked = "SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS before, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS after FROM documents"
    return f"SELECT DISTINCT query_id, x AS doc_id FROM (SELECT h.query_id, {d.array('h.doc_id', 'l.before', 'l.after')} AS xs FROM ({hit}) h JOIN ({linked}) l ON h.doc_id = l.doc_id) y {d.each('xs', 'x', 'pos')} WHERE x IS NOT NULL"


@plan
def w16_conversation_window(d):
    return "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) c WHERE rn <= 4"


@plan
def d12_history_prompt(d):
    last = "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) c WHERE rn <= 4"
    return f"SELECT conv_id, md5({d.strings('concat(role, chr(58), chr(32), text)', chr(10), 'turn')}) AS prompt FROM ({last}) l GROUP BY conv_id"


@plan
def a38_retrieval_statistics(d):
    return f"SELECT query_id, count(*) AS n, min(score) AS low, max(score) AS high FROM ({bm25(d)}) b GROUP BY query_id"


@plan
def a33_multi_query_rollup(d):
    return f"SELECT doc_id, max(score) AS best, min_by(query_id, query_id) AS first_query, count(*) AS n FROM ({bm25(d)}) b GROUP BY doc_id"


@plan
def u7_missing_ids(d):
    return "SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL"


@plan
def u8_subset_test(d):
    return "SELECT d.source, count(*) = count(e.vec_id) AS all_stored FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id GROUP BY d.source"


@plan
def w13_adjacent_merge(d):
    """Runs of documents that follow each other in their source among the hits, joined to one."""
    place = "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents"
    hit = f"SELECT p.doc_id, p.source, p.place FROM ({place}) p JOIN (SELECT DISTINCT doc_id FROM ({bm25(d)}) b) h ON p.doc_id = h.doc_id"
    island = "place - row_number() OVER (PARTITION BY source ORDER BY place)"
    return f"SELECT source, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n FROM (SELECT *, {island} AS island FROM ({hit}) h) i GROUP BY source, island"


# How many results an intent retrieves, reranks and returns.
DEPTHS = (("detailed_summary", 60, 40, 20), ("summary", 50, 30, 12), ("timeline", 40, 25, 12), ("comparison", 45, 25, 12), ("financial", 35, 20, 8), ("board", 40, 25, 10), ("governance", 40, 25, 10), ("committee", 40, 25, 10), ("product", 35, 20, 8), ("manufacturing", 35, 20, 8), ("table", 25, 15, 6), ("image", 25, 15, 6), ("list", 40, 20, 10), ("procedure", 30, 15, 8), ("statistics", 30, 15, 8), ("navigation", 30, 15, 8), ("explanation", 30, 15, 8), ("fact", 20, 10, 5))


@plan
def o6_intent_depths(d):
    """The depths of each conversation turn's intent."""
    t = rows(*DEPTHS, names="intent, retrieve, rerank, final")
    return f"SELECT q.conv_id, q.turn, coalesce(t.retrieve, 30) AS retrieve, coalesce(t.rerank, 15) AS rerank, coalesce(t.final, 8) AS final FROM (SELECT conv_id, turn, {intent(d, 'text')} AS intent FROM conversations) q LEFT JOIN {t} t ON q.intent = t.intent"


@plan
def s19_upsert_new(d):
    """Documents to embed and append: a source whose ids are all in the vector collection is skipped, else what it lacks."""
    return "SELECT d.doc_id, d.source FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL"


@plan
def u6_first_wins(d):
    """The first document of each text; whole texts aren't dealt out, only their digests."""
    return "SELECT md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY md5(text)"
