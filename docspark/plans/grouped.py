"""Plans whose meaning is sequential or graph-shaped: folds, communities, spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import models
from docspark.operators import alignment, graph, knn, packing, spelling, vectorindex
from docspark.operators.tables import written
from docspark.streaming import ingest
from docspark.plans.dialect import QUERIES, SPARK, frame, table, views
from docspark.plans.layout import classified
from docspark.plans.retrieval import FLOOR, nearest_sql, search_pairs
from docspark.plans.retrieval import QUERIES as SEARCHES
from docspark.plans.text import words


def _budget(d) -> str:
    """The choice as a recursion over ranks, not the fold."""
    from docspark.plans.retrieval import bm25, top

    hits = f"SELECT query_id, doc_id, rnk FROM ({top(bm25(d), 'query_id', 'score DESC, doc_id', 10)}) h"
    sized = f"SELECT h.query_id, h.rnk, h.doc_id, {d.int('floor(len(list_filter(string_split_regex(t.text, chr(92) || chr(115) || chr(43)), lambda w: length(w) > 0)) * 1.3) + 1')} AS n FROM ({hits}) h JOIN documents t ON h.doc_id = t.doc_id"
    return f"""WITH RECURSIVE s AS ({sized}), r AS (SELECT query_id, 0::BIGINT AS rnk, NULL::BIGINT AS doc_id, 0::BIGINT AS used, false AS taken FROM (SELECT DISTINCT query_id FROM s) q
    UNION ALL SELECT s.query_id, s.rnk, s.doc_id, CASE WHEN used + n + 50 <= 4000 THEN used + n + 50 ELSE used END, used + n + 50 <= 4000 FROM r JOIN s ON s.query_id = r.query_id AND s.rnk = r.rnk + 1)
    SELECT query_id, rnk::INT AS rnk, doc_id, taken FROM r WHERE rnk > 0"""


@frame(_budget)
def w12_token_budget(spark, sf_dir):
    """Of each question's best documents, in rank order, those that fit in a context of 4,000 tokens, 50 on top for each; tokens as in F10."""
    hits = QUERIES["o3_bm25_top"](spark, sf_dir).select("query_id", "doc_id", "rnk")
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    sizes = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.floor(n * 1.3) + 1).cast("int").alias("tokens"))
    taken = packing.within_budget(hits.join(sizes, "doc_id"), "query_id", "rnk", "tokens", 4000)
    return hits.join(taken, ["query_id", "rnk"])


@frame()
def w14_token_batches(spark, sf_dir):
    """Each document's paragraphs in batches of up to 12,000 tokens: a quarter of their characters, 10 at least."""
    parts = QUERIES["f6_paragraphs"](spark, sf_dir).select("doc_id", "paragraph_id", F.greatest(F.lit(10), F.floor(F.length("text") / 4)).alias("tokens"))
    return packing.batches(parts, "doc_id", "paragraph_id", "tokens", 12_000)


@frame()
def j6_paragraph_elements(spark, sf_dir):
    """Paragraphs of documents and the layout blocks that they come from."""
    blocks = QUERIES["f5_blocks"](spark, sf_dir).select("doc_id", F.col("block_id").alias("element_id"), "text")
    return alignment.align(QUERIES["f6_paragraphs"](spark, sf_dir), blocks)


@frame()
def f8_paragraph_parts(spark, sf_dir):
    """Paragraphs of documents in parts of up to 120 tokens."""
    parts = QUERIES["f6_paragraphs"](spark, sf_dir)
    return packing.split_parts(parts.select("doc_id", F.col("paragraph_id").cast("long").alias("ord"), "text"), 120)


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@table("vector_neighbours")
def vector_neighbours(spark, sf_dir):
    """For every vector whose id is divisible by 50, the ten nearest of all others."""
    vectors = _vectors(spark, sf_dir)
    return knn.nearest(vectors.where("vec_id % 50 = 0"), vectors, 10)


@table("similarity_edges")
def similarity_edges(spark, sf_dir):
    """The undirected graph in which every vector asks for its ten nearest of all others, at a floor."""
    return knn.edges(_vectors(spark, sf_dir), 10, FLOOR)


@table("question_neighbours")
def question_neighbours(spark, sf_dir):
    """The nearest vectors of the questions' own."""
    vectors = _vectors(spark, sf_dir)
    return knn.nearest(vectors.where(F.col("vec_id").isin([q for q, _ in SEARCHES])), vectors, 20)


@frame(lambda d: f"SELECT query_id, vec_id, similarity, rnk FROM ({nearest_sql(d, 'q.vec_id % 50 = 0', 10)}) n")
def o4_indexed_top(spark, sf_dir):
    """For every vector whose id is divisible by 50 the ten nearest of all others, by an index of inverted lists and its bounds."""
    vectors = _vectors(spark, sf_dir)
    return vectorindex.search(vectorindex.build(vectors, 32), vectors.where("vec_id % 50 = 0"), 10, 8, exact=True)


@frame()
def o4_index_recall(spark, sf_dir):
    """How much of the exact ten nearest an index finds in 24 of its 32 lists. The table's vectors are unrelated, which is the hardest case."""
    vectors = _vectors(spark, sf_dir)
    asking = vectors.where("vec_id % 50 = 0")
    return vectorindex.recall(vectorindex.search(vectorindex.build(vectors, 32), asking, 10, 24), knn.nearest(asking, vectors, 10))


@frame()
def d9_communities(spark, sf_dir):
    """Communities of the neighbour graph of each label's vectors, every vector asking."""
    vectors = _vectors(spark, sf_dir)
    edges = knn.edges(vectors, 10, FLOOR, "label")
    labels = vectors.select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("node"))
    mine = edges.join(labels, F.col("a") == F.col("node")).select("doc_id", "a", "b", F.col("similarity").alias("weight"))
    return graph.clusters(labels, mine)


@frame()
def d6_spelling(spark, sf_dir):
    """Suggestions from the corpus's own frequent words for its rare words of four letters or more, and for a few misspelt ones."""
    words = spark.createDataFrame([("licens",), ("wrok",), ("verison",), ("righst",), ("publik",)], "word string")
    known = written(QUERIES["s21_common_words"](spark, sf_dir).where("length(term) >= 4"), "known_words")
    common = known.where("freq >= 3").select("term", "freq")
    return spelling.suggestions(words.union(known.where("freq < 3").select("term")), common)


@frame()
def w15_chunks(spark, sf_dir):
    """Documents' blocks packed into chunks of 500 tokens with overlaps."""
    sql = f"SELECT doc_id, block_id AS ord, block_type AS kind, text FROM ({classified(SPARK)}) c WHERE doc_id IS NOT NULL"
    views(spark, sf_dir, sql)
    return packing.chunks(spark.sql(sql))


@frame()
def d1_offline_embeddings(spark, sf_dir):
    return models.embed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "embedding")


@frame(lambda d: f"SELECT query_id, doc_id, round({d.size(d.both(d.distinct(words(d, 'query')), d.distinct(words(d, 'text'))))} / {d.size(d.distinct(words(d, 'query')))}, 6) AS score FROM ({search_pairs(d)}) p")
def d2_offline_rerank(spark, sf_dir):
    """Questions and the documents found for them, scored by the offline substitute of a reranking model."""
    sql = search_pairs(SPARK)
    views(spark, sf_dir, sql)
    return spark.sql(sql).select("query_id", "doc_id", F.round(models.overlap_score(F.col("query"), F.col("text")), 6).alias("score"))


@frame(lambda d: "SELECT doc_id, source FROM documents")
def x5_upsert_stream(spark, sf_dir):
    """Documents read as a stream of files and upserted by id, twice; the second run adds nothing."""
    base = ingest.work_folder(spark)
    for run in ("a", "b"):
        stream = ingest.new_files(spark, f"{sf_dir}/documents.parquet*", "doc_id long, source string")
        ingest.upsert(stream, "doc_id", f"{base}/target", f"{base}/checkpoint-{run}").awaitTermination()
    return spark.read.parquet(f"{base}/target")
