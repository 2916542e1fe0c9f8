from __future__ import annotations

import os

import pandas as pd

from docspark.functions import models
from docspark.operators import graph, normalise, packing, spelling
from docspark.plans.findings import number_value
from docspark.sources import files
from docspark.streaming import ingest


def test_budget_skips_and_goes_on(spark):
    items = spark.createDataFrame([("q", 1, 100), ("q", 2, 500), ("q", 3, 80), ("r", 1, 900)], "g string, o int, t int")
    got = {(r.g, r.o): r.taken for r in packing.within_budget(items, "g", "o", "t", 300).collect()}
    assert got == {("q", 1): True, ("q", 2): False, ("q", 3): True, ("r", 1): False}


def test_batches_close_before_overflow(spark):
    items = spark.createDataFrame([("d", i, n) for i, n in enumerate([40, 40, 80, 120, 10])], "g string, o int, t int")
    got = [r.batch for r in packing.batches(items, "g", "o", "t", 160).orderBy("o").collect()]
    assert got == [0, 0, 0, 1, 1]


def test_communities():
    assert graph.communities([1, 2, 3, 4], [(1, 2, 0.9), (3, 4, 0.95)]) == {1: 0, 2: 0, 3: 1, 4: 1}
    assert graph.communities([1, 2], []) == {1: 0, 2: 1}


def test_clusters_by_document(spark):
    nodes = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "doc_id long, node long")
    edges = spark.createDataFrame([(1, 1, 2, 0.9)], "doc_id long, a long, b long, weight double")
    got = {(r.doc_id, r.node): r.cluster for r in graph.clusters(nodes, edges).collect()}
    assert got[1, 1] == got[1, 2] != got[1, 3] and got[2, 1] == 0


def test_spelling(spark):
    words = spark.createDataFrame([("libary",), ("enviroment",), ("house",)], "word string")
    known = spark.createDataFrame([("library", 5), ("environment", 4), ("house", 9), ("liberty", 99)], "term string, freq int")
    got = {r.word: r.suggestion for r in spelling.suggestions(words, known).collect()}
    assert got == {"libary": "library", "enviroment": "environment"}


def test_number_words(spark):
    df = spark.createDataFrame([("ten thousand five hundred",), ("twenty-one",), ("two million",), ("none here",), ("hundred",)], "t string")
    assert [r[0] for r in df.select(number_value(df["t"])).collect()] == [10500.0, 21.0, 2e6, None, 100.0]


def test_nfkc(spark):
    df = spark.createDataFrame([("ﬁne",), (None,)], "t string")
    assert [r[0] for r in df.select(normalise.nfkc("t")).collect()] == ["fine", None]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello \xff")
    (tmp_path / "b.xyz").write_text("x")
    (tmp_path / "dict.tsv").write_text("the 20000000\nrare 5\nbroken\n")
    got = {os.path.basename(r.path): r.supported for r in files.listing(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": True, "b.xyz": False, "dict.tsv": False}
    assert files.texts(spark, str(tmp_path)).first().text.startswith("hello")
    assert {r.term: r.is_common for r in files.dictionary(spark, str(tmp_path / "dict.tsv")).collect()} == {"the": True, "rare": False}
    pages = files.adapted(spark, str(tmp_path), "*.xyz", lambda b: [(1, b.decode()), (2, "end")])
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(1, "x"), (2, "end")]


def test_upsert_twice(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(source)
    for n in range(2):
        stream = ingest.new_files(spark, source, "id int, v string")
        ingest.upsert(stream, "id", target, str(tmp_path / f"ck{n}")).awaitTermination()
    assert spark.read.parquet(target).count() == 2


def test_windowed(spark):
    events = spark.createDataFrame(pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:10", "2024-01-01 00:50", "2024-01-01 01:10"]), "event_type": ["a", "a", "a"], "value": [1.0, 2.0, 3.0]}))
    assert sorted((r.n, r.total) for r in ingest.windowed(events).collect()) == [(1, 3.0), (2, 3.0)]


def test_chunks(spark):
    text = "One two three four five. " * 30
    parts = spark.createDataFrame([(1, 0, "heading", "Title"), (1, 1, "paragraph", text), (1, 2, "paragraph", text), (1, 3, "table", "| a |"), (2, 0, "paragraph", None)], "doc_id long, ord int, kind string, text string")
    got = packing.chunks(parts, budget=250, overlap=20).orderBy("doc_id", "chunk_no").collect()
    assert [(r.doc_id, r.kind) for r in got] == [(1, "heading"), (1, "paragraph"), (1, "paragraph"), (1, "table"), (2, "paragraph")]
    assert got[2].text.startswith("One two three four five. One two three four five.")


def test_offline_models(spark):
    df = spark.createDataFrame([(1, "red fox", "the red fox"), (2, "", "x"), (3, None, None)], "id int, q string, text string")
    vectors = [r.embedding for r in models.embed(df).orderBy("id").collect()]
    assert len(vectors[0]) == 64 and abs(sum(x * x for x in vectors[0]) - 1) < 1e-9 and set(vectors[2]) == {0.0}
    assert [r[0] for r in df.select(models.overlap_score(df["q"], df["text"])).collect()][:2] == [1.0, 0.0]
    assert models.reviewed(df, None, "id int").count() == 0
    assert models.reviewed(df, lambda p: p[["id"]], "id int").count() == 3


def test_nearest_vectors_over_all_blocks(spark):
    import numpy as np

    from docspark.operators import knn

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(60, 4)))  # many ties
    x[5] = 0
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(None, 0, [1.0] * 4), (60, 0, None)], "vec_id long, label int, embedding array<float>")
    good = [i for i in range(60) if x[i].any()]
    for within in (None, "label"):
        want = set()
        for q in good:
            if q % 5 == 0:
                near = [(-round(float(x[q] @ x[e] / np.sqrt((x[q] @ x[q]) * (x[e] @ x[e]))), 6), e) for e in good if e != q and (not within or e % 3 == q % 3)]
                want |= {(q, e, -s, r + 1) for r, (s, e) in enumerate(sorted(near)[:5])}
        for block in (7, 4096):
            got = {(r.query_id, r.vec_id, r.similarity, r.rnk) for r in knn.nearest(df.where("vec_id % 5 = 0"), df, 5, within, block).collect()}
            assert got == want
    assert {n for r in knn.edges(df, 3, -1.0).collect() for n in (r.a, r.b)} == set(good)


def test_every_vector_asks(spark):
    from docspark.plans.registry import queries

    data = "/root/testdata/sf0.001"
    ids = {r[0] for r in spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id is not null").select("vec_id").collect()}
    edges = queries()["f44_similarity_edges"](spark, data).collect()
    assert {n for r in edges for n in (r.a, r.b)} == ids
    found = queries()["d9_communities"](spark, data).toPandas()
    assert found.groupby(["doc_id", "cluster"]).size().ge(2).mean() > 0.5  # before, nearly all vectors were alone
    top = queries()["o4_vector_top"](spark, data).toPandas()
    assert len(top) == 5 * len({i for i in ids if i % 50 == 0})


def test_spelling_of_the_whole_corpus(spark):
    from docspark.plans.registry import queries

    data = "/root/testdata/sf0.001"
    rare = {r.term for r in queries()["s21_common_words"](spark, data).where("length(term) >= 4 and freq < 3").collect()}
    found = {r.word for r in queries()["d6_spelling"](spark, data).collect()}
    assert len(found & rare) > 100 and found <= rare | {"licens", "wrok", "verison", "righst", "publik"}


def test_spelling_equals_all_pairs_and_keys_stay_off_the_driver(spark):
    import random

    from docspark.operators import spelling

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    draw = random.Random(1)
    word = lambda: draw.choice(["", "", "internationally"]) + "".join(draw.choice("abé") for _ in range(draw.randint(1, 8)))
    terms = {word(): draw.randint(3, 9) for _ in range(80)}
    words = {word() for _ in range(120)} - terms.keys()
    found = spelling.suggestions(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(list(terms.items()), "term string, freq long"))
    got = {r.word: (r.distance, r.suggestion) for r in found.collect()}
    best = {w: min((apart(w, t), -f, t) for t, f in terms.items()) for w in words}
    assert got == {w: (b[0], b[2]) for w, b in best.items() if b[0] <= 2}
    assert "BroadcastHashJoin [key" not in found._jdf.queryExecution().executedPlan().toString()  # before, all keys of a dictionary went through the driver


def test_cues_and_looked_at_words_lose_no_match(spark, tmp_path):
    import random

    from docspark.operators import spans as span_ops
    from docspark.plans import registry  # noqa: F401
    from docspark.plans import spans

    draw = random.Random(2)
    bits = "http:// WWW. www.a @ a@b.c (Smith & Lee, 2020) [1, 2] [12] et al. a=b a-b \\alpha 1.5e-3 2^4 file.txt Dr. Mr.\nJones Ann Lee Ann\nLee Li !! wow!! internationally NASA iPhone x_y t5 c C x Tensor2Tensor attention my żółw Łódź 𠀀abc 𠀀x abc𠀀 é1 IV mmiv D't . , \n".split(" ")
    texts = [(i, "".join(draw.choice(bits) + draw.choice(["", " ", "\n"]) for _ in range(30))) for i in range(300)] + [(300, None), (301, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda df: sorted(map(tuple, df.collect()))
    plain = {n: p for n, p in spans._patterns().items() if n != "word"}
    assert rows(span_ops.found(docs, plain, cues=spans.CUES)) == rows(span_ops.found(docs, plain))
    span_ops.found(docs, spans._patterns()).createOrReplaceTempView("every_match")
    some = [f"text rlike {spans.SPARK.text(p)}" for p in (*spans.BY_WORD.values(), "^[A-Z]{6,}$")]
    want = f"select * from every_match where pattern <> 'word' or length(text) >= 14 or char_start < {spans.FIRST_PAGE} and text rlike {spans.SPARK.text(spans.CAPITALISED)} or {' or '.join(some)}"
    assert rows(spans.span_matches(spark, str(tmp_path))) == rows(spark.sql(want))
    assert span_ops.found(docs, {"word": spans._looked_at()}).count() < span_ops.found(docs, {"word": spans.WORDS}).count()


def test_repeated_terms_deal_out_only_terms_that_are_not_common(spark, tmp_path, monkeypatch):
    import random

    import duckdb

    from docspark.plans import registry, spans

    draw = random.Random(4)
    bits = ["the", "The", "rare-ish", "O'Hara", "o'hara", "Zürich", "x1y", "ab", "-abc-", "abc_d", "𠀀abc", "abc", "NASA", "\n", ",", "'tis'", *[f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]]
    texts = [(i, "".join(draw.choice(bits) + draw.choice([" ", " ", "", "\n"]) for _ in range(40))) for i in range(150)] + [(150, None), (151, ""), (None, "abc Once Once"), (152, "Once")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(map(tuple, duck.execute(registry.oracle_sql()["a4_repeated_terms"]).fetchall()))
    reasons = {w[4].split("x ")[1] for w in want}
    assert len(want) > 50 and "valid term" in reasons
    for most in (10**6, 0):  # common terms by a broadcast, by a shuffle
        monkeypatch.setattr(spans, "TERMS_AT_ONCE", most)
        got = registry.queries()["a4_repeated_terms"](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == want
    # before, all pieces of all texts were dealt out by document and sorted, once for each reader
    assert "posexplode" not in got._jdf.queryExecution().executedPlan().toString()
    plan = spans.repeated_terms(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "hashpartitioning(term" in plan


def test_best_by_single_precision_is_exact_and_blocks_are_not_dealt_out(spark, monkeypatch):
    import numpy as np

    from docspark.operators import knn

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 6)), np.tile(rng.normal(size=(1, 6)), (60, 1)), np.round(rng.normal(size=(140, 6)))]).astype(np.float32)
    x[9], x[480:490] = 0, x[3] + rng.normal(size=(10, 6)) * 1e-6  # likenesses that single precision can't tell
    x[17, 2] = np.nan
    ids = rng.permutation(500)
    u = x.astype(np.float64)
    u = u / np.where(np.abs(u).sum(1, keepdims=True) == 0, np.nan, np.sqrt((u * u).sum(1, keepdims=True)))
    good = [i for i in range(500) if np.isfinite(u[i]).all()]
    want = {}
    for q in good:
        near = sorted((-round(float(u[q] @ u[e]), 6), int(ids[e])) for e in good if e != q)
        want[int(ids[q])] = [(e, -s) for s, e in near[:7]]
    for step, slab, pairs in ((1024, 2048, 65536), (13, 5, 3), (64, 50, 40)):
        for name, n in (("STEP", step), ("SLAB", slab), ("PAIRS", pairs)):
            monkeypatch.setattr(knn, name, n)
        own = knn._ordered(ids.astype(np.int64), np.where(np.isnan(x), np.nan, x).astype(np.float64))
        best = knn._Best(*own, 7)
        for i in (300, 0):  # rows in any order, by parts
            best.see(*(a[i : i + 300] for a in own))
        got = best.rows().groupby("query_id")[["vec_id", "similarity"]].apply(lambda r: list(map(tuple, r.to_numpy().tolist()))).to_dict()
        assert got == want
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    found = knn.nearest(df, df, 7, block=100)
    rows = {}
    for r in found.orderBy("query_id", "rnk").collect():
        rows.setdefault(r.query_id, []).append((r.vec_id, r.similarity))
    assert rows == want  # before, a vector with NaN hid others from all that asked
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan  # before, blocks were shuffled for each that asks


def test_isolated_vectors(spark, tmp_path):
    from docspark.plans.registry import queries

    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [0.9, 0.1, 0.0], 0), (3, [0.0, 0.0, 1.0], 0), (4, [0.0, 0.0, 0.0], 0), (5, [float("nan"), 1.0, 1.0], 0), (6, None, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(r[0] for r in queries()["u9_isolated"](spark, str(tmp_path)).collect()) == [3, 4, 5, 6]
