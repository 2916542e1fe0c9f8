"""The training-data operators on small fixtures: nulls, empty and repeated rows, clashing columns; brute force and round trips."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docspark.llm import common, decontam, htmldiff, iblt, langid, licences, linededup, mixing, quality, records, simhash
from docspark.llm.queries import vocabulary

WORD_BPE = vocabulary("word_bpe_49k.json")
PIECES = vocabulary("piece_bpe_32k.model")
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, w string, key long"


def table(spark, texts, source=None, lang=None, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, lang[k] if lang else "en", source[k] if source else "s", len(t or ""), 1, 0.5, "x", 9) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, EXTRA)


def prose(rng, n, words=("alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "lamp", "green", "walk", "seven", "north")):
    return " ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [prose(rng, n) for n in (3, 40, 80, 200, 1, 500, 60, 60)]
    return [*out, out[3], out[3] + " tail", "", None, "  \n\t ", "A" * 4000, out[5].replace("alpha1", "beta2")]


# components
def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (10, 11), (11, 10), (None, 4), *[(20 + i, 21 + i) for i in range(40)]], "a long, b long")
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert got == {2: 1, 3: 1, 11: 10, **{21 + i: 20 for i in range(40)}}
    assert common.components(edges.where("a < 0")).count() == 0


# 1
def test_shares():
    assert mixing.shares([100, 100, 100], [3, 1, 2], 300, 2) == pytest.approx([150, 50, 100])
    got = mixing.shares([10, 1000, 1000], [3, 1, 2], 1500, 2)
    assert got[0] == 20 and sum(got) == pytest.approx(1500) and got[2] == pytest.approx(2 * got[1])
    assert mixing.shares([0, 5], [1, 1], 50, 2) == [0.0, 10]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_shard_counts_use_each_quota():
    for quota, size in (([1000, 1, 0, 537], 100), ([0, 3_000_000_001, 0, 6_000_000_002, 5], 10**9), ([0, 0], 5)):
        parts = [mixing.shard_counts(quota, size, s) for s in range(-(-sum(quota) // size))]
        assert [sum(c[i] for _, c in parts) for i in range(len(quota))] == quota
        assert all(min(c) >= 0 and sum(c) == size for _, c in parts[:-1])
        assert all([x + y for x, y in zip(a, c)] == b for (a, c), (b, _) in zip(parts, parts[1:]))
    assert sum(mixing._split([0, 600000001, 600000002], 600000001, [1])) == 600000001


@pytest.mark.parametrize("good,bad,n", [(5, 7, 4), (3000, 1000, 2500), (1, 100, 50), (40, 60, 99), (10**15, 3 * 10**15, 2 * 10**15)])
def test_draws_without_putting_back(good, bad, n):
    rng, total = np.random.default_rng(1), good + bad
    x = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(4000)], float)
    mean, sd = n * good / total, math.sqrt(n * (good / total) * (bad / total) * (total - n) / (total - 1))
    assert abs(x.mean() - mean) < 5 * sd / math.sqrt(len(x)) and abs(x.std() / sd - 1) < 0.08
    assert x.min() >= max(0, n - bad) and x.max() <= min(n, good)


def mix_fixture(spark):
    rng = random.Random(1)
    docs = [prose(rng, rng.randint(0, 400)) for _ in range(120)] + [None, "", "  "]
    docs[7] = docs[7].replace(" ", "\n\t")
    source = [["a", "b", None, "é", "zero"][4 if not (t or "").split() else i % 4] for i, t in enumerate(docs)]
    return docs, source, table(spark, docs, source).unionByName(table(spark, [docs[5], docs[5]], [source[5]] * 2, ids=[5, 5]))


def test_mix(spark):
    docs, source, df = mix_fixture(spark)
    got = mixing.mixed_sizes(df, block=16).toPandas()
    size = {i: len((t or "").split()) for i, t in enumerate(docs)}
    assert len(got) == 125 and all(size[r.doc_id] == r["size"] and 0 <= r.taken <= 2 * r["size"] for _, r in got.iterrows())
    by = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"))
    assert (by.index == by["size"]).all() and (abs(by.taken - by.target) <= 40).all()
    again = mixing.mixed_sizes(df.repartition(3), block=16).toPandas()
    key = ["doc_id", "taken"]
    assert got.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()
    assert mixing.mixed_sizes(df.where("doc_id < 0")).count() == 0


def test_mix_against_its_slots(spark):
    """Sizes and packed blocks, worked out again word by word from the slots and the places of the documents."""
    docs, source, df = mix_fixture(spark)
    mix = mixing.Mix(df, block=16, shard=64)
    streams: dict = {}
    for r in sorted(mix.placed.collect(), key=lambda r: (r.sid, r.at, r["size"])):
        stream = streams.setdefault(r.sid, [])
        assert len(stream) == r.at and r["size"] == len((docs[r.doc_id] or "").split())
        stream += [(r.doc_id, r.seq, r.bucket, w) for w in (docs[r.doc_id] or "").split()]
    taken, blocks = Counter(), {}
    for r in mix.slots().collect():
        words = streams[r.sid][16 * r.block : 16 * r.block + 16]
        taken.update((d, seq, bucket) for d, seq, bucket, _ in words)
        blocks[r.shard * 64 + r.slot] = (mix.names[r.sid], [w for *_, w in words])
    assert sorted(blocks) == list(range(len(blocks)))
    got = sorted((r.doc_id, r.taken) for r in mix.by_document().collect())
    want = {(r.doc_id, r.seq, r.bucket): 0 for r in mix.placed.collect()} | taken
    assert got == sorted((d, n) for (d, *_), n in want.items()) and len([1 for d, _ in got if d == 5]) == 3
    packed = {r.place: (r.source, r.text.split(), r.n_words) for r in mixing.packed_blocks(df.withColumn("_doc", F.lit(1)), block=16, shard=64).collect()}
    assert packed == {k: (name, words, len(words)) for k, (name, words) in blocks.items()}
    made = mixing.mixed_documents(df, block=16, shard=64)
    assert made.columns == df.columns and {r.doc_id: r.n_chars for r in made.collect()} == {r.doc_id: len(r.text) for r in made.collect()}
    assert made.where("lang is not null").count() == 0 and mixing.mixed_documents(df.where("doc_id < 0")).count() == 0


# 2
def test_forward_algorithm():
    v = langid.load(PIECES)
    model = langid.fit({"a": Counter({"the": 3, "and": 2}), "b": Counter({"der": 3, "und": 2})}, PIECES)
    at = {x: i for i, x in enumerate(v.pieces)}

    def brute(word):
        s, f = langid.MARK + word, [np.ones(2)]
        for e in range(1, len(s) + 1):
            f.append(sum((f[b] * model.p[at[s[b:e]]] if s[b:e] in at else f[b] * model.p[-1] for b in range(e) if s[b:e] in at or e == b + 1), np.zeros(2)))
        return np.log(f[-1])

    def paths(s):
        if not s:
            return [[]]
        return [[at.get(s[:e], len(model.p) - 1), *rest] for e in range(1, len(s) + 1) if s[:e] in at or e == 1 for rest in paths(s[e:])]

    uses, p = np.zeros(len(model.p)), model.p[:, 0]
    for word, times in (("thé", 3), ("and", 2)):
        each = [(np.prod(p[x]), x) for x in paths(langid.MARK + word)]
        for w, x in each:
            np.add.at(uses, x, times * w / sum(v for v, _ in each))
    assert np.allclose(langid.expected(["thé", "and"], np.array([3.0, 2.0]), v, p), uses)
    some = ["the", "thunder", "und", "éa", "日x", "a" * 32]
    assert np.allclose(langid.likelihoods(some, v, model.p), [brute(w) for w in some])


def test_language(spark):
    en, de = "the house and the river with that", "der fluss und das haus mit dem"
    rows = [(en if i % 2 else de) + f" {i}" for i in range(60)] + [None, "", "123 !", "x" * 500]
    df = table(spark, rows, lang=[("en" if i % 2 else "de") for i in range(60)] + [None] * 4)
    got = langid.identified(df, PIECES).toPandas().set_index("doc_id")
    assert (got.lang_pred[:60] == got.lang[:60]).all() and (got.lang_pred[60:63] == "und").all() and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got.held_out.items())
    assert set(langid.identified(df.withColumn("lang", F.lit(None).cast("string")), PIECES).toPandas().lang_pred) == {"und"}


# 3
def test_frames():
    def bitwise(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    rng = random.Random(3)
    some = [b"", b"123456789", *(rng.randbytes(n) for n in (1, 3, 4, 5, 63, 64, 65, 127, 128, 129, 1000, 5000))]
    assert records.crc32c(some).tolist() == [bitwise(x) for x in some] and bitwise(b"123456789") == 0xE3069283
    made = records.frames([b"abc", b"", b"x" * 300])
    data, offsets = b"".join(made), [0, len(made[0]), len(made[0]) + len(made[1])]
    assert records.unframe(data, offsets) == [b"abc", b"", b"x" * 300]
    for broken in (data[:13] + b"y" + data[14:], data[:2] + b"y" + data[3:], data[:-5], data[:-2]):
        with pytest.raises(ValueError):
            records.unframe(broken, offsets)
    assert records.unpack(records.pack(None, np.array([70_000, 2])))[1].tolist() == [70_000, 2]


def test_encoder_is_the_librarys():
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(WORD_BPE), records.Encoder(WORD_BPE, most=50, chunk=40), random.Random(1)
    letters = "abAB'sStredlvm \n\t\r\x0b\x1c\x85\xa0éİſŉ×÷ªµ²¼Ÿßẞ_-<|>12 .,!’Σ日̈"
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["x<|endoftext|>y", None, "", "word " * 300, "z" * 500]
    ids = list(own.encode(some))
    assert len(ids) == len(some)
    for text, ids in zip(some, ids):
        assert ids.tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_token_records(spark, texts):
    from tokenizers import Tokenizer

    df = table(spark, texts, ids=[(i * 7) % len(texts) if i else None for i in range(len(texts))])
    got = records.encoded(df, WORD_BPE).toPandas().sort_values("start", kind="stable")
    library, start = Tokenizer.from_file(WORD_BPE), 0
    by = {r.doc_id: r.text for r in df.collect()}
    ids = [None if pd.isna(x) else int(x) for x in got.doc_id]
    assert sorted(ids, key=lambda x: (x is not None, x)) == ids and len(ids) == len(texts)
    for i, (_, r) in zip(ids, got.iterrows()):
        own = np.array([*library.encode(by[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert records.encoded(df.where("doc_id < 0"), WORD_BPE).count() == 0
    folder = common.new_path(spark, "tokens")
    records.write(df, folder, WORD_BPE)
    drawn = records.shuffled(spark, folder, 3, 2).collect()
    places = [None if pd.isna(x) else int(x) for x in ids]
    assert sorted(r.place for r in drawn) == list(range(len(texts))) and [r.doc_id for r in drawn] != places
    assert all(r.ids == [*library.encode(by[r.doc_id] or "", add_special_tokens=False).ids, 1] for r in drawn)


def test_ranges_by_size(spark):
    ties = random.Random(1)
    rows = [(k if k % 3 else 7, 5_000_000 if k == 50 else 20_000, ties.randrange(-(2**63), 2**63)) for k in range(300)] + [(-(2**63), 0, 5), (9, None, 5)]
    df = spark.createDataFrame(rows, "key long, size long, tie long")
    pid, n, _ = common.by_size(df, F.col("key"), F.col("size"), F.col("tie"), 40)
    got = df.withColumn("pid", pid("key", "tie")).toPandas()
    hot = got[got.key == 7].pid
    assert got.pid.max() < n and hot.nunique() > 2 and hot.value_counts().max() < 50
    order = got.assign(tie=got.tie * (got.key == 7)).sort_values(["key", "tie"])
    assert order.pid.is_monotonic_increasing
    pid, n, _ = common.by_size(df.where("key is null"), F.col("key"), F.col("size"), F.col("tie"), 10)
    assert n == 1


# 4
def test_decontamination(spark):
    rng = random.Random(2)
    items = [prose(rng, 20), prose(rng, 3), "", None, prose(rng, 9)]
    docs = [prose(rng, 300) for _ in range(20)] + ["", None]
    docs[3] += " " + items[0].upper() + ". " + prose(rng, 50)
    near = items[0].split()
    near[1] = "changed"
    docs[4] += " " + " ".join(near)
    docs[5] += "\n" + items[1] + "\n"
    near[9] = near[15] = "changed"
    docs[6] += " " + " ".join(near)
    df = table(spark, docs).unionByName(table(spark, [docs[3]], ids=[3]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def shingles(t, k):
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = []
    for i, t in [*enumerate(docs), (3, docs[3])]:
        for j, x in enumerate(items):
            k = min(5, len((x or "").split()))
            if k and len(shingles(t, k) & shingles(x, k)) >= math.ceil(0.8 * len(shingles(x, k)) - 1e-9):
                want.append((i, j))
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()) == sorted(want) and (4, 0) in want and (5, 1) in want and (6, 0) not in want
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(22) if i not in {a for a, _ in want}]
    assert decontam.contaminated(df, bench.where("item_id < 0")).count() == 0 and decontam.contaminated(df.where("doc_id < 0"), bench).count() == 0


# 5
PAGE = '<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use</div>{}<aside>s</aside><footer>&copy; f</footer></body></html>'


def test_lines_of_a_page():
    html = PAGE.format('<main><article><header><h1>T &amp; x</h1><p>by me</p></header><p>One  <b>two</b><br>three<p>Four<script>var a="<p>";</script><div class="ad">AD<div>x</div></div><table><tr><td>a<td>b</tr></table><form>f<input></form><p class=notice>N<p>Five &lt;5&#233;</article><section id="comments"><article class="comment"><p>hi</p></article></section></main>')
    assert htmldiff.text_of(html, []).split("\n\n") == ["T & x", "One two three", "Four", "a b", "Five <5é"]
    assert htmldiff.lines(None) == ([], []) and htmldiff.lines("plain <text") == (["plain <text"], [0])


@pytest.mark.parametrize(
    "html,text",
    [
        ("<html><head><title>x</title><body><p>Hello world</p><p>More</p></body></html>", "Hello world|More"),
        ("<html><head><title>x</title><p>Hello</p>", "Hello"),
        ("<head><script>1</script>Text", "Text"),
        ("<body><nav><a>menu</a><p>A</p><p>x</p></body>", "menu|A|x"),
        ("<nav><li>menu<li>more</nav><p>A", "A"),
        ('<article><p class="login-guide">g</p><p class="promo-free">h</p><p class="ad-slot">i</p></article>', "g|h"),
        ('<div class="content widget"><p>a</p></div><div class="widget">b</div>', "a"),
        ('<div class="sidebar"><article><p>a</p></article></div>', "a"),
        ("<form><main><p>a</p><select><option>b</select></main></form>", "a"),
        ("<svg><p>a</p>", "a"),
        ("<p>a<script>b", "a"),
        ("<div hidden>x</div>y<!-- z", "y"),
        ('<p title="a>b">c</p><p title="d>e', "c|e"),
    ],
)
def test_markup_only_breaks_ties(html, text):
    assert htmldiff.text_of(html, []).split("\n\n") == text.split("|")


@pytest.mark.parametrize("unit", ['<a "', "<a \"'>'\">", "<svg>", '<p a="x', "<div>", "<li>", "<!--", "< ", "<script>", '<a b="c" d=', "&amp"])
def test_time_grows_with_the_page(unit):
    import time

    began = time.process_time()
    htmldiff.text_of(unit * (1_000_000 // len(unit)), [])
    assert time.process_time() - began < 6


def test_common_of_long_pages():
    rng = random.Random(2)
    a, b = ([rng.randint(0, 30) for _ in range(n)] for n in (300, 250))
    assert len(htmldiff.common(a, b, 500)) == len(htmldiff.common(a, b)) == len(htmldiff.common(b, a, 64))
    c = htmldiff.common(a, b, 500)
    at = iter(b)
    assert all(a[i] in at for i in c)


def plain_main_text(pages):
    """The whole query, page by page, with the table of longest common subsequences written out."""

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        out, i, j = [], len(a), len(b)
        while i and j:
            if t[i][j] == t[i - 1][j]:
                i -= 1
            elif t[i][j] == t[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append(i)
        return set(out)

    hosts: dict = {}
    for page_id, url, html in pages:
        host, path = htmldiff.split_url(url)
        hosts.setdefault(host, []).append((path, -1 if page_id is None else page_id, *htmldiff.lines(html)))
    out = []
    for rows in hosts.values():
        rows.sort(key=lambda r: r[:2])
        kinds = {tuple(r[2]) for r in rows if r[2]}
        on = Counter(x for k in kinds for x in set(k))
        for k, (path, page_id, own, flags) in enumerate(rows):
            sides = [next((r[2] for r in side if r[2] != own), None) for side in (rows[:k][::-1], rows[k + 1 :])]
            found = []
            for other in sides:
                if other is not None:
                    got, often = lcs(own, other), lambda i: on[own[i]] >= 3 and on[own[i]] > 0.1 * len(kinds)
                    alike = 2 * len(got) > max(len(own), len(other))
                    found.append({i for i in got if often(i) or not alike and not flags[i] & htmldiff.PARAGRAPH})
            gone = set()
            for i in set().union(*found):
                inside = flags[i] & htmldiff.ARTICLE and not flags[i] & htmldiff.NAMED
                if not inside or all(i in f for f in found) and on[own[i]] >= 3 and on[own[i]] > 0.5 * len(kinds) and not flags[i] & htmldiff.HEADING:
                    gone.add(i)
            keep = [i for i in range(len(own)) if i not in gone and not flags[i] & htmldiff.NAMED]
            inner = [i for i in keep if flags[i] & htmldiff.ARTICLE]
            out.append((page_id, "\n\n".join(own[i] for i in inner or keep)))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7])
def test_main_text_against_page_by_page(spark, parts):
    rng = random.Random(parts)
    pages = []
    for i in range(160):
        host, kind = rng.choice("abc"), rng.random()
        menu = "".join(f"<div>{host} menu {j}</div>" for j in range(rng.choice([2, 6])))
        body = [f"<p>{rng.choice(['Again', 'Now', f'Page {i} part {j}', f'Page {i} part {j}'])}</p>" for j in range(rng.randint(0, 6))]
        body = f"<h1>{rng.choice(['Title', f'Title {i}'])}</h1>" + "".join(body) + rng.choice(["<div>Read on</div>", ""])
        html = menu + (f"<article>{body}</article>" if kind < 0.4 else body) + f"<footer>{host} {rng.randint(0, 1)}</footer><p>Terms</p>"
        if kind > 0.8 and pages:
            html = rng.choice(pages)[2]  # a copy at another URL
        pages.append((i, f"https://{host}.org/{rng.randint(0, 60)}", None if kind < 0.03 else html))
    pages += [(200, None, "<p>x</p>"), (201, None, "<p>x</p>"), (None, "https://a.org/1", "<p>null id</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted((-1 if r.page_id is None else r.page_id, r.text) for r in htmldiff.main_text(df, parts).collect())
    assert got == plain_main_text(pages) and len({t for _, t in got}) > 50


def test_common_is_longest():
    rng = random.Random(1)

    def longest(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(500):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 12))] for _ in range(2))
        c = htmldiff.common(a, b)
        assert len(c) == longest(a, b) == longest([a[i] for i in c], b)


def test_main_text(spark):
    plain = "<div>Join our club today</div><p>{0} first</p><p>{0} second</p><p>{0} third</p>"
    pages = [(i, f"https://h.org/a/{i}", plain.format(f"Page {i}"), "x") for i in range(4)] + [(10, "https://h.org/z", None, "x"), (11, None, "", "x"), (12, "http://[bad", "<p>alone</p>", "x"), (13, "https://o.org/1", PAGE.format("<article><p>Same</p><p>A</p></article>"), "x"), (13, "https://o.org/1", PAGE.format("<article><p>Same</p><p>A</p></article>"), "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = htmldiff.main_text(df).toPandas()
    assert len(got) == 9 and (got.n_chars == got.text.str.len()).all()
    by = got.drop_duplicates("page_id").set_index("page_id").text
    assert [by[i] for i in range(4)] == [f"Page {i} first\n\nPage {i} second\n\nPage {i} third" for i in range(4)]
    assert by[10] == by[11] == "" and by[12] == "alone" and by[13] == "Same\n\nA"
    assert htmldiff.main_text(df.where("page_id < 0")).count() == 0


def test_main_text_of_large_templates(spark):
    menu = "".join(f"<div>Unnamed line {i}</div>" for i in range(8))
    text = lambda i, n=4: [f"Article {i} says {j}" for j in range(n)]
    page = lambda xs: menu + "".join(f"<p>{x}</p>" for x in xs)
    pages = [(i, f"https://t.org/{i}", page(text(i))) for i in range(5)]
    # a copy pair and an edited copy beside pages unlike them, and an exact copy at the end of its host
    long = text("x", 9)
    pages += [(10, "https://c.org/1", page(long)), (11, "https://c.org/2", page([*long[:8], "Edited"]))]
    pages += [(12 + i, f"https://c.org/{3 + i}", page(text(i, 20))) for i in range(30)]
    pages += [(50, "https://e.org/1", page(text("e", 20))), (51, "https://e.org/1?utm=1", page(text("e", 20))), (52, "https://e.org/2", page(text("f", 20)))]
    # only two pages, over half alike: a copy
    pages += [(60, "https://p.org/1", page(text("g"))), (61, "https://p.org/2", page(text("h")))]
    # inside article, first and last pages too
    pages += [(70 + i, f"https://a.org/{i}", f"<article><p>Read on</p>{''.join(f'<p>{x}</p>' for x in text(i))}</article>") for i in range(4)]
    by = {r.page_id: r.text.split("\n\n") for r in htmldiff.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [by[i] for i in range(5)] == [text(i) for i in range(5)]
    assert by[10] == long and by[11] == [*long[:8], "Edited"] and all(by[12 + i] == text(i, 20) for i in range(30))
    assert by[50] == by[51] == text("e", 20) and by[52] == text("f", 20)
    assert len(by[60]) == len(by[61]) == 12
    # a paragraph that all articles have stays, as it stands outside of articles nowhere
    assert [by[70 + i] for i in range(4)] == [["Read on", *text(i)] for i in range(4)]


# 6
def test_quality(spark):
    rng = random.Random(3)
    good = [prose(rng, 80) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, 80).split()) for _ in range(60)]
    df = table(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([*[(i, int(i < 60), 0) for i in range(120)], (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classified(df, labels).toPandas().set_index("doc_id")
    assert (got.predicted[:60] == 1).all() and (got.predicted[60:120] == 0).all() and got.score.between(0, 1).all() and len(got) == 122
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.held_out.items())
    held = spark.createDataFrame([(i, 1 - int(i < 60), 0) for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0], "doc_id long, quality int, toxic int")
    turned = labels.join(held.select("doc_id"), "doc_id", "left_anti").unionByName(held)
    assert quality.classified(df, turned).toPandas().set_index("doc_id").score.equals(got.score)  # held-out labels have no effect
    assert quality.classified(df.where("doc_id < 0"), labels.where("doc_id < 0")).count() == 0


def test_ftrl_against_plain():
    rng, own, z, n = random.Random(2), quality.Ftrl(bits=5, alpha=0.3, beta=1.0, l1=0.02, l2=0.1), [0.0] * 32, [0.0] * 32
    for _ in range(200):
        ids = sorted(rng.sample(range(32), 6))
        x, y = [rng.random() for _ in ids], float(rng.random() < 0.5)
        w = [0.0 if abs(z[i]) <= 0.02 else -(z[i] - math.copysign(0.02, z[i])) / ((1 + math.sqrt(n[i])) / 0.3 + 0.1) for i in ids]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
        for i, a, b in zip(ids, w, x):
            g = (p - y) * b
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.3 * a
            n[i] += g * g
        own.update(np.array(ids), np.array(x), y)
    assert np.allclose(own.z, z) and np.allclose(own.n, n)


def test_quality_keeps_columns(spark):
    rng = random.Random(3)
    df = table(spark, [prose(rng, 80) if i % 2 else " ".join(w.upper() + "!!" for w in prose(rng, 80).split()) for i in range(60)])
    df = df.withColumn("predicted", F.lit("mine")).withColumn("held_out", F.lit("mine"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    kept = quality.kept_rows(df, labels).collect()
    assert {r.doc_id for r in kept} == set(range(1, 60, 2)) and {(r.score, r.predicted, r.held_out) for r in kept} == {(0.5, "mine", "mine")}


# 7
def test_line_dedup(spark):
    pages = [(i, f"https://H.org/{i}", f"<script>x</script><div>Menu &amp; more</div><p>Text {i}</p>") for i in range(8)] + [(20, "https://o.org/", "<p>Menu &amp; more</p>"), (21, None, None), (22, "nohost", "")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    got = linededup.dedup(df).toPandas().set_index("page_id")
    assert [got.text[i] for i in range(8)] == [f"Text {i}" for i in range(8)] and (got.n_dropped[:8] == 1).all()
    assert got.text[20] == "Menu & more" and got.text[21] == got.text[22] == "" and len(got) == 11
    assert linededup.dedup(df.where("page_id < 0")).count() == 0


# 8
def test_fingerprints(spark, texts):
    df = table(spark, texts, ids=[None if i == 2 else i * 3 for i in range(len(texts))])
    got = iblt.fingerprints(df, parts=5).toPandas()
    assert len(got) == len(texts)
    order = [2, *[i for i in range(len(texts)) if i != 2]]
    by = {(-1 if pd.isna(r.doc_id) else int(r.doc_id)): r for _, r in got.iterrows()}
    like = lambda a, b: 1 - len({*a.tolist()} ^ {*b.tolist()}) / (len(a) + len(b)) if len(a) + len(b) else 1.0
    for i, j in zip(order, [*order[1:], order[0]]):
        own, after = texts[i] or "", texts[j] or ""
        changed, r = iblt.edited(own, after), by[-1 if i == 2 else 3 * i]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == iblt.fingerprint(own) and r.edited_fingerprint == iblt.fingerprint(changed)
        assert r.near_edited == pytest.approx(like(iblt.digests(own), iblt.digests(changed))) and r.near_next == pytest.approx(like(iblt.digests(own), iblt.digests(after)))
    assert iblt.fingerprints(df.where("doc_id < 0")).count() == 0 and iblt.fingerprints(df.where("doc_id = 0")).first().near_next == 1.0


def test_peeling_recovers_digests():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(0, 2**63, 5).astype(np.uint64)
    ((only_a, only_b),) = iblt.differences([np.concatenate([a, b])], [np.concatenate([a[100:], b[:2]])])
    assert set(only_a) == {*a[:100], *b[2:]} and len(only_b) == 0


def test_peeling_ends_on_a_forged_check_sum():
    a = np.array([11, 12], np.uint64)
    s = iblt.sketch([a], 12)
    s.count[:], s.keys[:], s.checks[:] = 0, 0, 0
    for key in (5, 6, 7):  # a lone cell whose check sum fits its key
        for cell in range(12):
            s.count[cell], s.keys[cell], s.checks[cell] = 1, key, iblt._check(np.array([key], np.uint64))[0]
    *_, done = s.peel()
    assert not done.any()
    same = np.array([9, 9], np.uint64)  # no set of digests has one twice; it ends all the same
    assert len(iblt.differences([same], [np.zeros(0, np.uint64)])[0][0]) == 1


# 9
def plain_fingerprint(text):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("leaf", [4096, 3])
def test_simhash(spark, texts, leaf):
    rng = random.Random(5)
    base = prose(rng, 300).split()
    many = [" ".join([*base[:i], "new", *base[i + 1 :]]) for i in range(0, 300, 5)]
    every = [*texts, *many, many[0]]
    df = table(spark, every, ids=[None if i == 1 else i for i in range(len(every))])
    got = simhash.near_duplicates(df, leaf=leaf).toPandas()
    prints = [plain_fingerprint(t) for t in every]
    root = list(range(len(every)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    want = {}
    for i, r in enumerate(root):
        want[r] = min(want.get(r, 10**9), i if i != 1 else 10**9)
    for _, r in got.iterrows():
        i = 1 if pd.isna(r.doc_id) else int(r.doc_id)
        assert r.fingerprint == f"{prints[i]:016x}"
        assert (None if pd.isna(r.component_id) else r.component_id) == (None if want[root[i]] == 10**9 else want[root[i]])
    assert len(got) == len(every)
    kept = simhash.one_of_each(df, leaf=leaf)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(x for x in want.values() if x != 10**9)
    assert simhash.near_duplicates(df.where("doc_id < 0")).count() == 0


def test_one_row_of_each(spark):
    a, b, c = (prose(random.Random(seed), 60) for seed in (1, 2, 3))
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (3, c), (3, c + " more"), (4, None), (None, ""), (5, "an unlike text of a few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(df).collect()]
    assert [r for r in kept if r[0] in (1, 2)] == [(1, a)] and [r for r in kept if r[0] is None] == [(None, b)]
    assert len([r for r in kept if r[0] == 3]) == 1 and len(kept) == 5
    assert simhash.one_of_each(df.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("n,radius,trees", [(10, 4, 3), (10**6, 4, 3), (10**10, 4, 3), (10**4, 5, 2), (100, 2, 3)])
def test_trees_find_all_pairs(n, radius, trees):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    y = x ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, radius + 1), replace=False)) for _ in x], np.uint64)
    met = np.zeros(len(x), bool)
    for tree in simhash.planted(n, radius, trees):
        assert len(tree.masks) and np.bitwise_or.reduce(tree.masks).bit_count() == tree.most.sum()
        stored = next(iter(tree.shards(np.concatenate([x, y]))))[1]
        asks = [(int(a), int(s)) for k, (at, shards) in enumerate(tree.shards(np.concatenate([x, y]))) if k for a, s in zip(at, shards)]
        assert len(asks) == len(set(asks))
        asks = set(asks)
        met |= [stored[i] == stored[i + 300] or (i, int(stored[i + 300])) in asks or (i + 300, int(stored[i])) in asks for i in range(300)]
    assert met.all()


def test_trees_prune():
    x = np.random.default_rng(3).integers(0, 2**64, 2000, dtype=np.uint64)
    for tree in simhash.planted(100_000):
        d = tree.distances(x)
        assert (np.abs(d[:1000, None] - d[None, 1000:]).sum(axis=2) <= tree.radius).mean() < 0.01


# 10
def test_licences(spark):
    docs = ["Released under the MIT License.\nmore text here", "licensed under the apache license version 2.0", "nothing of the kind at all", None, "", "one", "All rights reserved.\nAll rights reserved."]
    got = [(r.doc_id, r.unit, r.licence) for r in licences.scan(table(spark, docs)).orderBy("doc_id", "unit").collect()]
    assert {(0, 1, "MIT"), (1, 1, "Apache-2.0"), (6, 1, "proprietary"), (6, 2, "proprietary")} <= set(got) and {d for d, *_ in got} == {0, 1, 6}
    assert licences.scan(table(spark, docs), templates=()).count() == 0 and licences.scan(table(spark, docs).where("doc_id < 0")).count() == 0


def test_telling_words_are_in_every_match():
    rng = random.Random(4)
    for _, text in licences.TEMPLATES:
        grams = licences.bigrams_of(text)
        need = math.ceil(len(grams) * 0.8 / 1.2 - 1e-9)
        words = set(licences.telling(grams, need))
        assert words and sum(not words.isdisjoint(g.split()) for g in grams) > len(grams) - need
        for _ in range(50):  # whichever bigrams a match has, one of the words is in them
            assert any(not words.isdisjoint(g.split()) for g in rng.sample(grams, need))


def test_licences_wrapped_and_embedded(spark):
    import textwrap

    mit, gpl = licences.TEMPLATES[3][1], licences.TEMPLATES[12][1]
    other = "".join(f"plain words {i} about rivers {i} under the bridge {i}\n" for i in range(40))
    changed = gpl.replace("redistribute", "share redistribute").replace("any later", "any other later")
    docs = [other + textwrap.fill("MIT License Copyright (c) 2020 Acme " + mit + " THE SOFTWARE IS PROVIDED AS IS", 78) + "\n" + other, other + "# " + "\n# ".join(textwrap.wrap(changed, 40)), "(c) 2020 Acme. All rights reserved.", other + "(c) Acme, all\nrights reserved, and so on\n(c) Bcme, all rights reserved now", "Released under the MIT License.\n" + other, other]
    got = [(r.doc_id, r.unit, r.licence, r.template, round(r.dice, 2)) for r in licences.scan(table(spark, docs)).orderBy("doc_id", "unit").collect()]
    assert [g[:4] for g in got] == [(0, 41, "MIT", 3), (1, 41, "GPL-3.0", 12), (2, 1, "proprietary", 23), (3, 41, "proprietary", 23), (3, 43, "proprietary", 23), (4, 1, "MIT", 0)]
    assert got[0][4] == got[2][4] == got[3][4] == got[4][4] == 1 and 0.8 <= got[1][4] < 1


@pytest.mark.parametrize("name", ["op4_decontamination", "op7_line_dedup", "op10_licences"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from docspark.llm import queries

    con, data = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = queries.queries()[name](spark, data).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert sorted(map(tuple, got[cols].round(9).values.tolist())) == sorted(map(tuple, want[cols].round(9).values.tolist()))


def test_pipeline(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = docs.limit(3).select(F.lit(None).cast("long").alias("doc_id"), *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns[1:]])
    docs = docs.unionByName(odd).unionByName(docs.limit(5)).withColumn("score", F.lit("mine")).withColumn("_doc", F.lit(3))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, data)
        assert after.columns == docs.columns and after.where("score <> 'mine'").count() == 0
        assert stage(spark, docs.where("doc_id < -5"), data).count() == 0
        docs = common.written(after, "test-stage")
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    places = [r.doc_id for r in last.orderBy("start").collect()]
    assert places == list(range(docs.count())) and places


def test_pipeline_stages_against_brute_force(spark):
    """What each stage keeps, worked out from the stage before without the operators' own search."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    good, single, clean, mixed, last = (None,) * 5
    before, kept = docs, []
    for _, stage in corpus_pipeline.STAGES:
        before = common.written(stage(spark, before, data), "test-stage")
        kept.append(before)
    good, single, clean, mixed, last = kept
    predicted = {r.doc_id for r in quality.classified(docs, spark.read.parquet(f"{data}/labels.parquet")).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == predicted
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4 and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert sorted(r.doc_id for r in single.collect()) == [rows[k][0] for k in sorted(set(root))]
    cut = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    items = [w for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() if (w := cut(r.text))]
    holds = lambda w: any(len(grams(w, k := min(5, len(x))) & grams(x, k)) >= math.ceil(0.8 * len(grams(x, k)) - 1e-9) for x in items)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in single.collect() if not holds(cut(r.text)))
    words = Counter()
    for r in mixed.collect():
        words.update((r.source, w) for w in r.text.split())
    n = {(r.doc_id, r.source): r.taken for r in mixing.Mix(clean).by_document().join(clean.select("doc_id", "source"), "doc_id").collect()}
    own = Counter(r.source for r in clean.collect() for _ in (r.text or "").split())
    taken = Counter()
    for (_, source), k in n.items():
        taken[source] += k
    assert {s: sum(k for (x, _), k in words.items() if x == s) for s in own} == {s: taken[s] for s in own}
    library = Tokenizer.from_file(WORD_BPE)
    want = [(r.doc_id, [*library.encode(r.text, add_special_tokens=False).ids, 1]) for r in mixed.orderBy("doc_id").collect()]
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in last.orderBy("start").collect()] == [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in want]


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = "\n".join(prose(rng, 300) for _ in range(700))
    df = table(spark, [long, long, long + " tail", "short", None])
    items = spark.createDataFrame([(0, " ".join(long.split()[-40:]))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.contaminated(df, items).collect()) == [0, 1, 2]
    assert len({r.component_id for r in simhash.near_duplicates(df).collect()}) == 3
    got = {r.doc_id: r for r in iblt.fingerprints(df).collect()}
    assert got[0].near_next == 1 and 0.99 < got[1].near_next < 1
    assert [r["size"] for r in mixing.mixed_sizes(df).orderBy("doc_id").collect()] == [210_000, 210_000, 210_001, 1, 0]
    assert licences.scan(df).count() == 0
    pages = spark.createDataFrame([(i, f"https://h.org/{i}", "<p>" + long.replace("\n", f"</p><p>{i} ")) for i in range(3)], "page_id long, url string, html string")
    assert [len(r.text.split("\n\n")) for r in htmldiff.main_text(pages).collect()] == [699] * 3  # all three have the first line
    assert linededup.dedup(pages).agg(F.min("n_lines")).first()[0] == 700
