"""Inputs that no cap may cut: long words, long tags, many open quotes; and what of an article differencing may not delete."""

from __future__ import annotations

import time

import numpy as np
import pytest

from docspark.llm import htmldiff, langid
from docspark.llm.queries import vocabulary

PIECES = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    from collections import Counter

    return langid.fit({"en": Counter({"the": 3, "and": 2, "this": 2}), "de": Counter({"der": 3, "und": 2, "die": 2})}, PIECES)


# 2
def test_long_words_are_scored_as_short_ones(monkeypatch, model):
    v, some = langid.load(PIECES), ["the", "thunder", "und", "éa", "日x", "a" * 30, "theandderundthis"]
    want = langid.likelihoods(some, v, model.p)
    times, p = np.arange(1.0, len(some) + 1), model.p[:, 0]
    uses = langid.expected(some, times, v, p)
    monkeypatch.setattr(langid, "LONG", 0)
    monkeypatch.setattr(langid, "PART", 5)
    assert np.allclose(langid.likelihoods(some, v, model.p), want)
    assert np.allclose(langid.expected(some, times, v, p), uses)


def test_words_of_any_length(model):
    v = langid.load(PIECES)
    long = "undder" * 9000
    got = langid.likelihoods([long], v, model.p)[0]
    assert np.isfinite(got).all() and got.argmax() == model.languages.index("de")

    def brute(word):  # logs of sums of products, as a likelihood of this length is no float
        s, at = langid.MARK + word, {x: i for i, x in enumerate(v.pieces)}
        f = [np.zeros(2)]
        for e in range(1, len(s) + 1):
            f.append(np.logaddexp.reduce([f[b] + np.log(model.p[at.get(s[b:e], -1)]) for b in range(max(0, e - v.longest), e) if s[b:e] in at or e == b + 1]))
        return f[-1]

    for word in ("theund" * 12, "é日" * 40):
        assert np.allclose(langid.likelihoods([word], v, model.p)[0], brute(word))
    lang, score = langid.Scorer(model).score([long, "der " + long, None, "the and this"])
    assert lang == ["de", "de", "und", "en"] and score[0] > 0.99
    assert langid.words("A" * 100) == ["a" * 100]


# 5
def text(html):
    return htmldiff.text_of(html, [])


def test_attributes_of_any_length():
    page = f'<article><p>Kept.</p><div data-x="{"y" * 50_000}" class="comments"><p>A comment</p></div></article>'
    assert text(page) == "Kept."


def test_any_number_of_open_quotes():
    broken = "".join(f"<p title=\"it's {i}>Line {i}</p>" if i % 2 else f"<p title='{i}>Line {i}</p>" for i in range(41))
    assert text(broken + '<p title="a>b">T</p>').split("\n\n")[-1] == "T"
    for part in ("<a href=\"x' ", "<a b='\" ", "<a ' \" ", '<p title="x>y '):
        began = time.time()
        list(htmldiff.tokens(part * 60_000))
        list(htmldiff.tokens(part * 60_000 + ">"))
        assert time.time() - began < 8


def test_sections_about_search_stay():
    page = '<article><h1>Manual</h1><section id="search"><h2>Search</h2><p>How to search</p></section></article>'
    assert text(page) == "Manual\n\nSearch\n\nHow to search"
    for gone in ('<section id="comments"><h2>Comments</h2><p>Mine</p></section>', '<section class="related"><h2>More</h2><p>Teaser</p></section>', '<section id="search"><p>Find</p></section>', '<div id="search"><h2>Find</h2><p>It</p></div>'):
        assert text(f"<article><p>Text.</p>{gone}</article>") == "Text."


def test_formulas_stay():
    assert text("<article><p>Let <math><mi>x</mi></math> be real.</p></article>") == "Let x be real."


def pages(spark, bodies, host="h.example.org"):
    return spark.createDataFrame([(i, f"http://{host}/a/{i:03}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")


def test_paragraphs_of_articles_stay_unless_they_are_template_outside(spark):
    bodies = [f"<article><h1>Head {i}</h1><p>Often said.</p><p>Everywhere said.</p><p>Own words {i} {'x' * i}</p></article>" for i in range(12)]
    bodies[11] = "<div><p>Everywhere said.</p></div>" + bodies[11]
    got = {r.page_id: r.text for r in htmldiff.main_text(pages(spark, bodies)).collect()}
    assert all("Often said." in t for t in got.values()) and not any("Everywhere said." in got[i] for i in range(1, 10))


def test_pages_without_telling_markup_are_told_by_differences(spark):
    """Nothing but div elements: what neighbours share goes, what is a page's own stays."""
    bodies = [f"<div>Menu Home</div><div>Our offers</div><div>Title {i}</div><div>Story number {i} with its own words.</div><div>More of story {i}.</div><div>All rights reserved</div>" for i in range(8)]
    got = {r.page_id: r.text for r in htmldiff.main_text(pages(spark, bodies)).collect()}
    assert got == {i: f"Title {i}\n\nStory number {i} with its own words.\n\nMore of story {i}." for i in range(8)}


def test_fingerprints_work_on_few_texts_at_once(monkeypatch):
    import pandas as pd

    from docspark.llm import iblt

    texts = [f"{i} long text. " * 20_000 for i in range(40)] + ["", "x"] * 900
    batch = pd.DataFrame({"pid": 0, "edge": [0] * (len(texts) - 1) + [1], "doc_id": range(len(texts)), "text": texts})
    sizes, each = [], iblt._rows
    monkeypatch.setattr(iblt, "_rows", lambda ids, some: sizes.append(sum(map(len, some))) or pd.DataFrame({"doc_id": ids[:-1]}))
    ids = [i for out in iblt._each_with_next(iter([batch])) for i in out["doc_id"]]
    assert ids == list(range(len(texts) - 1))
    assert max(sizes) < 3_000_000  # before, 1,024 texts of any length
    monkeypatch.setattr(iblt, "_rows", each)
    small = batch.tail(1500)
    monkeypatch.setattr(iblt, "CHARS_AT_ONCE", 20)
    parts = pd.concat(iblt._each_with_next(iter([small])), ignore_index=True)
    assert parts.equals(each(small["doc_id"].tolist(), small["text"].tolist()))
