"""Phrase collocations: which words stand together more often than their parts do, for each language.

Frequent phrases are mined by contiguous pattern growth. A frequent word is a prefix; its projection holds a pointer for each
occurrence: the words that follow there, up to ``longest`` in all and not beyond a word that is too rare to be in a frequent
phrase. A task that reads texts packs what it has of a prefix's projection into one row, equal pointers once with their number.
A prefix is then one task's work: its pointers come together and are sorted, so what a longer prefix is projected to is a
range of them, and growth goes to the right, depth first. Words that are more than half of a task's mean share of the corpus
are no prefixes of their own, but the words behind them make longer ones, and so on, so no prefix that a task gets is hot;
phrases of such words alone are counted as they are.

Which words are frequent is told in tasks by a bit map of fixed size, set by hashes of the frequent words: it may let rare words
pass, which costs rows but changes no result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import release, written

#: Words of a phrase; fewest occurrences of a candidate; percent of a phrase's occurrences that a longer one must have to stand for it.
LONGEST, LEAST, COVERED = 3, 10, 50
#: Rows of a language in the result, and what a score of 1 is.
TOP, UNIT = 2000, 1_000_000
#: Bits of the map of frequent words; distinct words, words of text and pointers that a task holds at a time; bytes of text split at a time.
MAP_BITS, HELD, TOKENS, POINTERS, PART = 1 << 26, 400_000, 2_000_000, 500_000, 4 << 20

# What ends a piece, and the white space between words.
ENDS, SPACE = b".,;:!?\n\x0b\x0c\r", b" \t"
_TABLE = bytes(0x0A if i in ENDS else 0x20 if i in SPACE else i for i in range(256))
#: No word can be one of these, as they end pieces: between pieces, or nothing more; the word of the pointer before.
BREAK, SAME = b".", b","
ROWS = "lang string, prefix string, size int, rest binary, counts binary, n long"


def _tokens(text: str) -> Iterator[list[bytes]]:
    """The words of a text in lists of whole pieces, with BREAK between pieces."""
    data = text.encode().lower().translate(_TABLE)  # bytes.lower changes A to Z only
    at = 0
    while at < len(data):
        end = data.find(b"\n", at + PART)
        end = len(data) if end < 0 else end
        yield data[at:end].replace(b"\n", b" . ").split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter[bytes]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            del counts[BREAK]
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = held.setdefault(lang, Counter())
            for tokens in _tokens(text):
                counts.update(tokens)
            if len(counts) > HELD // 4 and sum(map(len, held.values())) > HELD:
                yield from out()
    yield from out()
    release()


class _Ids(dict):
    """Numbers of the words of one language from 1 on; 0 for BREAK and for words that can't be frequent."""

    def __init__(self, lang: str, bits: np.ndarray):
        self.seed, self.bits, self.names = xxhash.xxh64_intdigest(lang.encode(), seed=42), bits, [BREAK]
        self[BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, seed=self.seed) % (len(self.bits) * 8)
        k = 0
        if self.bits[h >> 3] >> (h & 7) & 1:
            k = len(self.names)
            self.names.append(word)
        self[word] = k
        return k


def _pointers(ids: np.ndarray, k: int, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of a word and what follows it, one column a place (0: nothing more), and their numbers; ids below k."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    code = ids[at]
    room = k
    for j in range(1, longest):
        nxt = np.where(at + j < len(ids), ids[np.minimum(at + j, len(ids) - 1)], 0)
        nxt = np.where(last > 0, nxt, 0) if j > 1 else nxt
        last = nxt
        if room * k >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            room = len(code)
        code, room = code * k + nxt, room * k
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    rows, cols = at[first], []
    alive = np.ones(len(rows), bool)
    for j in range(longest):
        c = np.where(alive & (rows + j < len(ids)), ids[np.minimum(rows + j, len(ids) - 1)], 0)
        alive = c > 0
        cols.append(c)
    return cols, n


def _rows(lang: str, cols: list[np.ndarray], n: np.ndarray, names: list[bytes], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted pointers as rows of prefixes: with all that follows packed, or, where all words before the last are hot, with their number alone."""
    longest = len(cols)
    lead, depth, size = hot[cols[0]], np.ones(len(n), int), np.zeros(len(n), int)
    for c in cols:
        size += c > 0
    for j in range(1, longest):
        depth += lead
        lead = lead & hot[cols[j]]
    lead = depth - 1 + lead  # hot words in front

    def starts(own: np.ndarray, d: int) -> np.ndarray:
        new = np.zeros(len(own), bool)
        new[0] = True
        for c in cols[:d]:
            new[1:] |= c[own[1:]] != c[own[:-1]]
        return np.flatnonzero(new)

    def prefixes(rows: np.ndarray, d: int) -> pa.Array:
        return pa.array([b" ".join([names[c[i]] for c in cols[:d]]) for i in rows.tolist()], pa.binary()).cast(pa.string())

    def made(rows: np.ndarray, d: int, total: np.ndarray, rest: list | None, counts: list | None) -> pa.RecordBatch:
        none = pa.nulls(len(rows), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(rows)), prefixes(rows, d), pa.array(np.full(len(rows), d, np.int32)), none if rest is None else pa.array(rest, pa.binary()), none if counts is None else pa.array(counts, pa.binary()), pa.array(total)],
            ["lang", "prefix", "size", "rest", "counts", "n"],
        )

    for d in range(2, longest + 1):
        own = np.flatnonzero((size >= d) & (lead >= (d if d < longest else d - 1)))
        if len(own):
            at = starts(own, d)
            yield made(own[at], d, np.add.reduceat(n[own], at), None, None)
    words = [*names, SAME]
    for d in range(1, longest):
        own = np.flatnonzero((depth == d) & (size >= d))
        if not len(own):
            continue
        at = starts(own, d)
        rest = np.stack([c[own] for c in cols[d:]], axis=1)
        again = np.zeros(len(own), bool)
        again[1:] = rest[1:, 0] == rest[:-1, 0]
        again[at] = False
        rest[again, 0] = len(names)
        flat = list(map(words.__getitem__, rest.ravel().tolist()))
        ends, num, w = [*at[1:].tolist(), len(own)], n[own].astype(np.uint32), longest - d
        bounds = list(zip(at.tolist(), ends, strict=True))
        for k in range(0, len(bounds), 20_000):
            some = bounds[k : k + 20_000]
            first = at[k : k + 20_000]
            total = np.add.reduceat(n[own[: some[-1][1]]], first)
            yield made(own[first], d, total, [b" ".join(flat[a * w : b * w]) for a, b in some], [num[a:b].tobytes() for a, b in some])


def _projected(sent, longest: int):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Ids] = {}
        held: dict[str, list[np.ndarray]] = {}
        (bits, hot_words), size = sent.value, 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                names = known[lang].names
                cols, n = _pointers(np.concatenate(parts), len(names), longest)
                if len(n):
                    mine = hot_words.get(lang, ())
                    yield from _rows(lang, cols, n, names, np.fromiter((x in mine for x in names), bool, len(names)))
            held.clear()
            if sum(map(len, known.values())) > HELD:
                known.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = known.get(lang)
                if ids is None:
                    ids = known[lang] = _Ids(lang, bits)
                for tokens in _tokens(text):
                    held.setdefault(lang, []).append(np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens)))
                    held[lang].append(np.zeros(1, np.int64))
                    size += len(tokens) + 1
                if size > TOKENS:
                    yield from out()
                    size = 0
        yield from out()
        release()

    return project


def _grow(cols: list[np.ndarray], num: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Frequent ranges of pointers that are sorted by ``cols``, of which the first tells prefixes apart: (row, columns, sum).

    Growth is to the right, depth first; a range of one column is a prefix itself.
    """

    def groups(lo: int, hi: int, by: np.ndarray, some: int) -> Iterator[tuple[int, int, int]]:
        part = by[lo:hi]
        at = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        sums, ends = np.add.reduceat(num[lo:hi], at), np.append(at[1:], hi - lo)
        ok = (sums >= least) & (part[at] >= some)
        return zip((lo + at[ok]).tolist(), (lo + ends[ok]).tolist(), sums[ok].tolist(), strict=True)

    def grow(lo: int, hi: int, size: int) -> Iterator[tuple[int, int, int]]:
        for a, b, total in groups(lo, hi, cols[size], 1):  # 0: nothing more
            yield a, size + 1, total
            if size + 1 < len(cols):
                yield from grow(a, b, size + 1)

    for a, b, total in groups(0, len(num), cols[0], 0):
        yield a, 1, total
        yield from grow(a, b, 1)


def _mined(rows: list[tuple], least: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Frequent phrases of two words or more of rows of whole prefixes."""
    sums: Counter[tuple[str, str, int]] = Counter()
    packed: dict[int, list[tuple]] = {}
    for lang, prefix, size, rest, counts, n in rows:
        if rest is None:
            sums[lang, prefix, size] += n
        else:
            packed.setdefault(size, []).append((lang, prefix, rest, counts))
    found = [(*key, n) for key, n in sums.items() if n >= least]
    for size, own in packed.items():
        prefixes: dict[tuple[str, str], int] = {}
        ids: dict[bytes, int] = {BREAK: 0, SAME: -1}
        parts, key = [], np.fromiter((prefixes.setdefault((lang, prefix), len(prefixes)) for lang, prefix, _, _ in own), np.int64, len(own))
        for *_, rest, _ in own:
            parts += rest.split(b" ")
        flat = np.fromiter((ids.setdefault(x, len(ids)) for x in parts), np.int64, len(parts)).reshape(-1, longest - size)
        num = np.frombuffer(b"".join(c for *_, c in own), np.uint32).astype(np.int64)
        cols = [np.repeat(key, [len(c) // 4 for *_, c in own]), *flat.T]
        cols[1] = cols[1][np.maximum.accumulate(np.where(cols[1] >= 0, np.arange(len(num)), 0))]
        by = np.lexsort(cols[::-1])
        cols, num = [c[by] for c in cols], num[by]
        names, heads = list(ids), list(prefixes)
        for i, k, total in _grow(cols, num, least):
            if size + k > 2:
                lang, prefix = heads[cols[0][i]]
                found.append((lang, " ".join([prefix, *[names[c[i]].decode() for c in cols[1:k]]]), size + k - 1, total))
    if found:
        lang, phrase, size, total = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(phrase), pa.array(size, pa.int32()), pa.array(total, pa.int64())], ["lang", "phrase", "size", "n"])


def _grown(least: int, longest: int):
    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by ``deal``; whole prefixes are mined together, the one that goes on waits."""
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            deal, *cols = (c.to_pylist() for c in batch.columns)
            for k, row in zip(deal, zip(*cols, strict=True), strict=True):
                if k != last and size >= POINTERS:
                    yield from _mined(held, least, longest)
                    held, size = [], 0
                last = k
                held.append(row)
                size += len(row[4] or b"") // 4 + 1
        if held:
            yield from _mined(held, least, longest)
        release()

    return grown


def _bits(frequent: DataFrame, bits: int) -> np.ndarray:
    """A map with a bit for the hash of each ``frequent(lang, word)``; at most ``bits`` / 64 numbers come to the driver."""
    at = F.pmod(F.xxhash64("lang", "word"), F.lit(bits))  # the modulus is a power of two, so signs don't matter
    slots = frequent.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 31 as int)))").alias("bits"))
    out = np.zeros(bits // 32, np.uint32)
    got = slots.toArrow()
    out[got.column("slot").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = MAP_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows ``(lang, phrase, size, n)``: all words and phrases of up to ``longest`` words that occur ``least`` times or more;
    and rows ``(lang, n)``: occurrences of all words.

    Occurrences are contiguous, within a piece, and may overlap. See ``collocations`` for words, pieces and nulls.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text <> ''")
    words = own.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(words, "words")
    frequent = words.where(F.col("n") >= least)
    total = words.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (8 * POINTERS) + 1)
    hot: dict[str, set[bytes]] = {}
    for lang, word in frequent.where(F.col("n") * 2 * parts > total).select("lang", "word").collect():  # fewer than 2 * parts
        hot.setdefault(lang, set()).add(word.encode())
    sent = spark.sparkContext.broadcast((_bits(frequent, bits), hot))
    pointers = own.mapInArrow(_projected(sent, longest), ROWS)
    dealt = pointers.select(F.xxhash64("lang", "prefix").alias("deal"), "*").repartition(parts, "deal").sortWithinPartitions("deal")
    out = dealt.mapInArrow(_grown(least, longest), "lang string, phrase string, size int, n long")
    out = out.unionByName(frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n"))
    return written(out, "phrases"), words.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """Rows ``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of 2 to ``longest`` words of each language of ``docs(lang, text)``.

    A to Z count as small letters. Texts are cut into pieces at ``[.,;:!?]`` and line ends, and those into words at spaces and
    tabs. Candidates occur ``least`` times or more (a); cut after k words, their parts occur l and r times, and the cut of
    lowest score, floor(1,000,000 a a / (l r)), counts, ties by k. A candidate goes if a longer one around it has ``covered``
    percent of its occurrences. Ranks are by score, a (both descending) and phrase, up to ``top`` in a language: ties have an
    order. A null lang is ``und``; null and empty texts have no words; repeated rows count again; texts are read whole; empty
    tables give no rows; other columns don't matter.
    """
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    known, totals = phrases(docs, least, longest)
    many = known.where("size > 1")
    w = F.split("phrase", " ")
    around = many.where("size > 2").select("lang", F.explode(F.array(F.array_join(F.slice(w, 1, F.col("size") - 1), " "), F.array_join(F.slice(w, 2, F.col("size") - 1), " "))).alias("phrase"), F.col("n").alias("longer"))
    # a longer phrase holds one of size + 1 around the candidate that is as frequent at least, so that size is enough
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = many.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("n"))).drop("longer")
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    left, right = F.array_join(F.slice(w, 1, F.col("k")), " "), F.array_join(F.slice(w, F.col("k") + 1, longest), " ")
    cuts = cuts.select("*", left.alias("left"), right.alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    wide = {c: f"cast({c} as decimal(38, 0))" for c in "alr"}
    cuts = cuts.withColumn("score", F.expr(f"cast({UNIT} as decimal(38, 0)) * {wide['a']} * {wide['a']} div ({wide['l']} * {wide['r']})"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("b")).select("lang", "phrase", "a", "b.*")

    # the best of shares of a language first, so no task sorts a whole language
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = best.withColumn("_share", share).withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_at") <= top)
    ranked = some.drop("_share", "_at").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, {LONGEST + 1})) AS size FROM w),
g AS (SELECT lang, size, w[i:i + size - 1] AS ws, count(*) AS f FROM (SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM s WHERE len(w) >= size) GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, ws, f AS a FROM g WHERE size > 1 AND f >= {LEAST}),
x AS (SELECT lang, w, max(a) AS longer FROM (SELECT lang, a, ws[1:size - 1] AS w FROM c WHERE size > 2 UNION ALL SELECT lang, a, ws[2:size] FROM c WHERE size > 2) GROUP BY ALL),
k AS (SELECT c.lang, ws, size, a, unnest(range(1, size)) AS k FROM c LEFT JOIN x ON c.lang = x.lang AND c.ws = x.w WHERE longer IS NULL OR 100 * longer < {COVERED} * a),
q AS (SELECT k.lang, k.ws, a, k, l.f AS l, r.f AS r, (a::HUGEINT * a * {UNIT} // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM k JOIN g l ON l.lang = k.lang AND l.ws = k.ws[1:k] JOIN g r ON r.lang = k.lang AND r.ws = k.ws[k + 1:k.size]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) AS nr FROM q),
o AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank FROM b WHERE nr = 1)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN t ON o.lang = t.lang WHERE rank <= {TOP}
"""
