"""Versioned collections, the cache by content and the matcher of many keywords."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import matcher
from docspark.operators.collections import Cache, Collection, Taken, replace_uploads
from docspark.operators.tables import new_path

SCHEMA = "id long, value string"


def content(c):
    return sorted((r.id, r.value) for r in c.rows().collect())


def test_merges_replace_by_key(spark):
    rng, want = random.Random(1), {}
    c = Collection(spark, new_path(spark, "c"), "id", 4)
    assert c.rows() is None and c.ids() is None and c.merge() == 0 and c.merge(gone=spark.createDataFrame([(1,)], "id long")) == 0
    for version in (1, 2, 3):
        new = {rng.randrange(30): f"{version}.{i}" for i in range(8)}
        gone = [rng.randrange(30) for _ in range(4)]
        rows = spark.createDataFrame([*new.items(), (None, "null")], SCHEMA)
        assert c.merge(rows, spark.createDataFrame([(g,) for g in gone], "id long")) == version
        want = {k: v for k, v in want.items() if k not in gone} | new
        assert content(c) == sorted(want.items())
    before = c.manifest()
    c.merge(gone=spark.createDataFrame([(k,) for k in want], "id long"))
    assert content(c) == [] and sorted((r.id, r.value) for r in c.rows(before).collect()) == sorted(want.items())  # a reader of the version before
    c.vacuum()
    assert content(c) == [] and c.merge(spark.createDataFrame([(5, "a"), (5, "b")], SCHEMA)) == 5 and content(c) == [(5, "a"), (5, "b")]


def test_a_merge_that_dies_or_loses_changes_nothing(spark, monkeypatch):
    c = Collection(spark, new_path(spark, "c"), "id", 3)
    c.merge(spark.createDataFrame([(i, "old") for i in range(9)], SCHEMA))
    two = Collection(spark, c.folder, "id", 99)  # buckets are the manifest's
    with monkeypatch.context() as m:
        m.setattr(two, "_commit", lambda manifest: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            two.merge(spark.createDataFrame([(1, "dead")], SCHEMA))
    assert content(c) == [(i, "old") for i in range(9)] and c.manifest()["version"] == 1
    stale = c.manifest()
    c.merge(spark.createDataFrame([(2, "first")], SCHEMA))
    with monkeypatch.context() as m:
        m.setattr(two, "manifest", lambda: stale)
        with pytest.raises(Taken):
            two.merge(spark.createDataFrame([(2, "second")], SCHEMA))
    assert dict(content(c))[2] == "first"


def test_only_missing_ids_are_added(spark):
    c = Collection(spark, new_path(spark, "c"), "id")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    assert c.add_missing(rows) and not c.add_missing(rows.withColumn("value", F.lit("other"))) and c.manifest()["version"] == 1
    assert c.add_missing(spark.createDataFrame([(2, "x"), (3, "c")], SCHEMA)) and content(c) == [(1, "a"), (2, "b"), (3, "c")]


def test_replaced_uploads_lose_their_artifacts(spark):
    up, art = Collection(spark, new_path(spark, "u"), "filename"), Collection(spark, new_path(spark, "a"), "job")
    files = lambda *x: spark.createDataFrame(list(x), "filename string, job long")
    made = lambda *x: spark.createDataFrame(list(x), "job long, artifact string")
    replace_uploads(up, art, files(("a.pdf", 1), ("b.pdf", 2)), made((1, "x"), (1, "y"), (2, "z")))
    for _ in range(2):  # again: the same
        replace_uploads(up, art, files(("a.pdf", 3), ("c.pdf", 4)), made((3, "n")))
        assert sorted(map(tuple, up.rows().collect())) == [("a.pdf", 3), ("b.pdf", 2), ("c.pdf", 4)]
        assert sorted(map(tuple, art.rows().collect())) == [(2, "z"), (3, "n")]


def test_cache_makes_each_content_once(spark):
    cache, made = Cache(spark, new_path(spark, "cache"), "long"), []

    def make(df):
        made.extend(r.text for r in df.collect())
        return df.select("sha", F.length("text").cast("long").alias("result"))

    one = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, None), (4, ""), (5, "bbb")], "id long, text string")
    assert sorted((r.id, r.result, r.hit) for r in cache.through(one, "text", make).collect()) == [(1, 2, False), (2, 2, False), (3, None, None), (4, 0, False), (5, 3, False)]
    two = spark.createDataFrame([(i, "x" * i) for i in range(40)] + [(50, "aa")], "id long, text string")
    got = {r.id: (r.result, r.hit) for r in cache.through(two, "text", make).collect()}
    assert got == {**{i: (i, i == 0) for i in range(40)}, 50: (2, True)}
    assert sorted(made) == sorted(["aa", "", "bbb", *["x" * i for i in range(1, 40)]]) and cache.stored().count() == 42
    cache.through(two, "text", make).count()
    assert len(made) == 42 and cache.stored().select("sha").distinct().count() == 42


def test_matcher_against_contains(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abÉ ") for _ in range(n))
    tables = {f"t{i}": [word(rng.randint(1, 5)) for _ in range(6)] + [""] for i in range(5)} | {"none": [], "upper": ["AB"]}
    texts = [word(rng.randint(0, 30)) for _ in range(60)] + [None, "", "AÉB"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, tables string")
    want = {i: sorted(n for n, ws in tables.items() if any(w and w.lower() in (t or "").lower() for w in ws)) for i, t in enumerate(texts)}
    assert {r.id: r.tables for r in matcher.tagged(df, "text", tables).collect()} == want
    words = {i: sorted({w.lower() for ws in tables.values() for w in ws if w and w.lower() in (t or "").lower()}) for i, t in enumerate(texts)}
    assert {r.id: r.k for r in matcher.tagged(df, "text", tables, "k", keywords=True).collect()} == words
    assert all(r.tables == [] for r in matcher.tagged(df, "text", {}).collect())
