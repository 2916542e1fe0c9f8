"""The index of vectors against all pairs: exact by bounds, recall by lists, crowded lists, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest

from docspark.operators import knn, vectorindex


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x)], "vec_id long, embedding array<float>")


def rows(df):
    return sorted((r.query_id, r.vec_id, r.similarity, r.rnk) for r in df.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    means = rng.normal(size=(20, 16))
    x = means[rng.integers(0, 20, 1200)] + 0.15 * rng.normal(size=(1200, 16))
    x[600:900] = x[600]  # a third are copies
    return table(spark, x)


def test_exact_search_is_all_pairs(spark, clustered, monkeypatch):
    monkeypatch.setattr(vectorindex, "CELL", 100)  # lists and their asking vectors are in many cells
    asking = clustered.where("vec_id % 25 = 0")
    index = vectorindex.build(clustered, 16, cell=100)
    assert index.cells.agg({"n": "max"}).first()[0] >= 3 and index.rows.count() == 1200
    want = rows(knn.nearest(asking, clustered, 7))
    assert rows(vectorindex.search(index, asking, 7, 2, exact=True)) == want
    assert rows(vectorindex.search(index, asking, 7, 16)) == want
    got = vectorindex.search(index, asking, 7, 3)
    # clusters are in few lists, so three of sixteen find nearly all
    assert vectorindex.recall(got, knn.nearest(asking, clustered, 7)).first().recall > 0.95


def test_bounds_save_work_on_clusters(spark, clustered):
    index = vectorindex.build(clustered, 16)
    near = vectorindex._lists(index.centres, spark, index.radii, 2)
    first = {r.query_id: r.similarity for r in vectorindex.search(index, clustered.where("vec_id % 25 = 0"), 7, 2).collect() if r.rnk == 7}
    asked = spark.createDataFrame(list(first.items()), "vec_id long, least double").join(clustered, "vec_id")
    lists = asked.select(near("embedding", "least").alias("l")).selectExpr("avg(size(l)) AS n").first().n
    assert lists < 5  # of the 14 others


def test_odd_vectors(spark):
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (None, [1.0, 1.0]), (5, [1.0, 0.1]), (5, [1.0, 0.1])], "vec_id long, embedding array<float>")
    index = vectorindex.build(some, 8)
    assert [(r.query_id, r.vec_id) for r in vectorindex.search(index, some.where("vec_id = 1"), 3, 1, exact=True).collect()] == [(1, 5), (1, 5)]
    empty = vectorindex.build(some.where("false"))
    assert vectorindex.search(empty, some, 3, 1, exact=True).count() == 0 and vectorindex.recall(vectorindex.search(empty, some, 3, 1), knn.nearest(some, some, 2)).first().found == 0
