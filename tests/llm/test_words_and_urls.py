"""Spelling variants, URL filter and collocations against brute force; nulls, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docspark.llm import collocations, urlfilter, variants

EXTRA = "doc_id long, text string, lang string, source string, n long, word string, score double, host string"


def table(spark, texts, lang=None, ids=None):
    return spark.createDataFrame([(i, t, lang[k] if lang else "en", "s", 1, "x", 0.5, "h") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))], EXTRA)


# 11
def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def near_of(counts):
    out = {}
    for w in counts:
        own = [v for v in counts if near(w, v)]
        if own:
            best = min(own, key=lambda v: (-counts[v], v))
            out[w] = (len(own), best, counts[best])
    return out


@pytest.mark.parametrize("block", [1, 3, 40, 10_000])
def test_neighbours_against_all_pairs(spark, block):
    rng = random.Random(block)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(250)} | {"start" + "".join(rng.choice("abcdefghij") for _ in range(3)) + "end" for _ in range(120)}
    words |= {"z" * n for n in (1, 2, 3, 200, 201, 202, 5000)} | {"x", "ÿ" * 5, "ÿ" * 4 + "à"}
    counts = {w: rng.randint(2, 40) for w in words}
    got = variants.neighbours(spark.createDataFrame(list(counts.items()), "word string, n long"), block)
    assert {r.word: (r.n_near, r.near, r.near_n) for r in got.collect()} == near_of(counts)


def test_variants_against_brute_force(spark):
    rng = random.Random(7)
    stems = ["lanterns", "Lanternes", "meadowlark", "ÉTÉchansons", "abcdefghijkl", "mountaine", "riverbank", "rivrbanks", "zzzzzzzz", "short"]
    texts = [" ".join(rng.choice(stems) for _ in range(rng.randint(0, 160))) for _ in range(60)]
    texts += [None, "", "  ", "a1b2", texts[3], "q" * 40_000, "q" * 40_000, "lanterns" * 3, "×÷×÷×÷×÷ ×÷×÷×÷×÷"]
    ids = [*range(60), 60, 61, 62, None, 3, 64, 65, 66, 67]
    counts: Counter = Counter()
    for i, t in zip(ids, texts):
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    pairs, form = near_of(counts), {}
    for w, n in counts.items():
        if w in pairs and pairs[w][2] >= 10 * n:
            form[w] = pairs[w][1]

    def root(w):
        return root(form[w]) if w in form else w

    want = {w: (n, pairs.get(w, (0,))[0], form.get(w), counts.get(form.get(w)), root(w)) for w, n in counts.items()}
    df = table(spark, texts, ids=ids)
    got = variants.variants(df, block=5).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want and len(got) == len(want) and len(form) > 10
    assert variants.variants(df.where("doc_id < 0")).count() == 0
    with pytest.raises(ValueError):
        variants.variants(df, ratio=1)


def test_roots_follow_all_forms(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(18)] + [("other", "w05"), ("a", "b")]
    got = {r.word: r.root for r in variants._roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{w: "w18" for w, _ in chain}, "a": "b"}


# 12
URLS = [None, "", "no scheme", "http://", "http://Example.ORG", "https://example.org/", "https://example.org/es/x", "https://a.b.example.org/es/", "https://notexample.org/es/", "https://example.org/en/1?x=/es/", "https://example.org/en/2#/",
        "ftp://x.com/fr/", "http://x.com/de/#", "http://x.com:80/de/", "http://com/fr/1", "http://x.com?/fr/", "http://x.net/a://b.org/es/", "x://\n.org/\n/", "http://é.org/É", "HTTP://WWW.EXAMPLE.org/EN/1", "https://example.org/en/1" + "a" * 50_000]


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = []
    for rule, verdict in rules:
        at, begin = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == at or host.endswith("." + at)) and path.startswith(begin):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


@pytest.mark.parametrize("inline", [200, 0])
def test_rules(spark, inline):
    rules = [*urlfilter.RULES, ("b.example.org/", "allow"), ("com/fr/", "allow"), ("com/f", "block"), ("co/", "block")]
    frame = spark.createDataFrame([*rules, (None, "block"), ("nothing", "block"), ("net/", None)], "rule string, verdict string")
    urls = spark.createDataFrame([(u,) for u in URLS * 2], "url string").withColumns({"host": urlfilter.host(F.col("url")), "path": urlfilter.path(F.col("url"))})
    got = urlfilter.ruled(urls, frame, inline).collect()
    assert {(r.url, r.host, r.path, r.rule, r.ruled) for r in got} == {(u, *judge(u, rules)) for u in URLS} and len(got) == 2 * len(URLS)


def lexical_urls(rng, n):
    """Blocked ones have many parameters and digits, and some a last label that tells."""
    out = []
    for k in range(n):
        bad = rng.random() < 0.4
        name = "".join(rng.choice("abcdef") for _ in range(8)) + ("".join(rng.choice("0123456789") for _ in range(4)) if bad else "")
        tail = "?" + "&".join(f"p{i}={rng.randint(0, 99)}" for i in range(4)) if bad and rng.random() < 0.8 else ""
        out.append((f"http://{name}.{'biz' if bad and rng.random() < 0.5 else 'net'}/a/{k % 7}{tail}", int(bad)))
    return out


def test_trees_learn_from_labels(spark):
    rng = random.Random(3)
    train, test = lexical_urls(rng, 1500), lexical_urls(rng, 400)
    rules = spark.createDataFrame([("org/", "allow")], "rule string, verdict string")
    labelled = spark.createDataFrame([*train, ("http://x.net/", None), (None, 0)], "url string, label int")
    urls = spark.createDataFrame([(i, u, "kept", "gone") for i, (u, _) in enumerate(test)] + [(-1, None, "kept", "gone"), (-2, "http://x.org/", "kept", "gone"), (0, test[0][0], "kept", "gone")], "page_id long, url string, more string, score string")
    out = urlfilter.judged(urls, rules, labelled)
    assert out.columns == ["page_id", "url", "more", "host", "path", "rule", "verdict", "score"]
    got = out.collect()
    want = {i: "block" if y else "allow" for i, (_, y) in enumerate(test)}
    assert len(got) == 403 and sum(r.verdict == want[r.page_id] for r in got if r.page_id >= 0) > 0.93 * 401
    assert {(r.rule, r.verdict, r.score) for r in got if r.page_id == -2} == {("org/", "allow", None)}
    assert all(0 <= r.score <= 1 and (r.verdict == "block") == (r.score > 0.5) for r in got if r.rule is None)
    again = urlfilter.judged(urls.repartition(3), rules, labelled.repartition(5)).collect()
    assert sorted((r.page_id, r.verdict, r.score or 0) for r in again) == sorted((r.page_id, r.verdict, r.score or 0) for r in got)


def test_judged_without_labels_to_learn_from(spark):
    rules = spark.createDataFrame(urlfilter.RULES, "rule string, verdict string")
    one = spark.createDataFrame([(u,) for u in (None, "http://a.net/", "http://a.net/")], "url string")
    assert [(r.verdict, r.rule) for r in urlfilter.judged(one, rules).collect()] == [("allow", None)] * 3
    blocked = one.union(spark.createDataFrame([(f"http://a{i}.com/de/",) for i in range(9)], "url string"))
    assert {r.verdict for r in urlfilter.judged(blocked, rules).collect()} == {"block"}
    assert urlfilter.judged(one.where("false"), rules).count() == 0 and urlfilter.judged(one, rules.where("false")).count() == 3


# 13
def brute_collocations(rows, least, longest, covered=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        own = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + s] for p, a in own.items() for s in range(2, len(p)) for i in range(len(p) - s + 1) if 100 * a >= covered * counts[p[i : i + s]]}
        some = []
        for p, a in own.items():
            if p not in gone:
                score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                some.append((-score, -a, " ".join(p).encode(), a, left, right))
        out += [(lang, i + 1, p.decode(), a, left, right, n[lang], -s) for i, (s, _, p, a, left, right) in enumerate(sorted(some)[:top])]
    return sorted(out)


def collocation_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["The", "of", "É", "日本", "x" * 300]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 300))) for _ in range(60)]
    texts = [re.sub(" ", lambda m: rng.choice([" ", " ", " ", " \t", ". ", "\n", ",", "\x0b"]), t) for t in texts]
    texts += [None, "", " \t ", ".,;", "new york city " * 30, "new york city. " * 9, texts[2], "a a a a a a a a a a a a a a", "San\xa0Jose san\xa0jose " * 12, "sep\x1cs \x85 " * 11]
    lang = [("en", "fr", None, "und")[i % 4] for i in range(len(texts))]
    return texts, lang


@pytest.mark.parametrize("longest,least,map_bits,points", [(3, 10, 1 << 26, 300_000), (3, 10, 64, 50), (2, 10, 1 << 20, 300_000), (5, 6, 128, 20)])
def test_collocations_against_brute_force(spark, monkeypatch, longest, least, map_bits, points):
    monkeypatch.setattr(collocations, "MAP_BITS", map_bits)
    monkeypatch.setattr(collocations, "POINTERS", points)  # few of them: many tasks, so prefixes are hot
    monkeypatch.setattr(collocations, "TOKENS", 2_000 if points < 100 else 1_500_000)
    monkeypatch.setattr(collocations, "PART", 40 if points < 100 else 4 << 20)
    monkeypatch.setattr(collocations.phrases, "__defaults__", (least, longest, map_bits))
    texts, lang = collocation_texts()
    df = table(spark, texts, lang)
    got = collocations.collocations(df, least, longest, top=40).collect()
    assert sorted(tuple(r) for r in got) == brute_collocations(zip(lang, texts), least, longest, top=40)
    assert collocations.collocations(df.where("doc_id < 0")).count() == 0


def test_collocation_scores_are_exact(spark):
    """Counts whose products pass 64 bits, on the columns that the score is worked out from."""
    a, left, right = 9_000_000_000_001, 9_000_000_000_007, 9_123_456_789_011
    wide = {c: f"cast({c} as decimal(38, 0))" for c in "alr"}
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(f"cast({collocations.UNIT} as decimal(38, 0)) * {wide['a']} * {wide['a']} div ({wide['l']} * {wide['r']}) AS score").first()[0]
    assert got == 10**6 * a * a // (left * right)
