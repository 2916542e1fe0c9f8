"""Spelling variants: which words of a corpus are one inserted, deleted or replaced character apart.

Words come from maximal runs of letters; about one run in 31 loses a letter by a checksum, which plants known variants.
Their near pairs are found in forward and reversed sorted dictionaries. One edit leaves one half of the shorter word whole:
words near each other share its first half (a block of the forward dictionary) or else its last half (a block of the
reversed one). A block of more than ``BLOCK`` words is subdivided by the same argument: what its words don't share yet has
halves of its own, so the block splits into blocks of longer shared parts, until they are small or one character is left.
No block is capped. Blocks are then ranges of a sorted table, dealt out by range and scanned in order; pairs are verified
character by character, and a pair counts in one block only, told by the length of its common prefix.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import release, written

#: Words in a block that is scanned; larger ones are subdivided.
BLOCK = 96
#: Fewest characters of a word and fewest occurrences; how many times as frequent a form is; which share of runs loses a letter.
LENGTH, LEAST, RATIO, PLANTED = 7, 2, 10, 31
#: Distinct words that a task holds before it passes their counts on; bytes of characters compared at a time.
HELD, AT_ONCE = 300_000, 8 << 20
#: Blocks to subdivide, and forms, are broadcast up to this many rows (8 bytes each), joined by shuffle beyond.
BROADCAST_ROWS = 200_000


def _counted(length: int, planted: int):
    run = re.compile(f"[a-zÀ-ÿ]{{{length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{doc or ''}:".encode())
                # bytes.lower changes A to Z only
                for w, n in Counter(run.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(w.encode(), start)
                    if h % planted == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < length:
                            continue
                    held[w] += n
                if len(held) > HELD:
                    yield out()
        yield out()
        release()

    return count


def vocabulary(docs: DataFrame, length: int = LENGTH, least: int = LEAST, planted: int = PLANTED) -> DataFrame:
    """Rows ``(word, n)``: words of ``length`` characters or more that occur ``least`` times or more in ``docs(doc_id, text)``.

    Runs are maximal in ``[A-Za-z\\u00C0-\\u00FF]``, A to Z in small letters. With h the CRC-32 of ``<doc_id>:<run>``, a run loses
    the character at h modulo its length if ``planted`` divides h. A null doc_id counts as an empty one; null and empty
    texts have no runs; repeated rows count again. Texts and runs of any length are read whole.
    """
    own = docs.select(F.col("doc_id").cast("string").alias("doc"), "text")
    words = own.mapInArrow(_counted(length, planted), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _keyed(df: DataFrame, *ways: tuple[str, Column, Column, Column, Column]) -> DataFrame:
    """``df`` once for each of ``ways`` (step, short, low, high, limit): the row's block is what it shares there.

    The first ``low`` and the last ``high`` characters are shared in a block, in which one word of each pair has ``short``
    characters, the other as many or one more; a pair belongs to it if its common prefix is shorter than ``limit``.
    """
    size = F.length("word")
    both = F.explode(F.array(*[F.struct(short.alias("short"), low.alias("low"), high.alias("high"), limit.alias("limit"), F.concat("path", F.lit(step)).alias("path")) for step, short, low, high, limit in ways])).alias("b")
    out = df.select("word", "n", both).select("word", "n", "b.*")
    shared = F.concat(F.expr("substring(word, 1, low)"), F.reverse(F.expr("substring(word, length(word) - high + 1, high)")))
    return out.select("word", "n", "short", "low", "high", "limit", "path", shared.alias("shared"), (size > F.col("short")).alias("long"))


def _split(df: DataFrame) -> DataFrame:
    """The rows of blocks in two new ones each: by the first half of what they don't share yet, and by the last half."""
    short, low, high, limit = (F.col(c) for c in ("short", "low", "high", "limit"))
    half = F.floor((short - low - high) / 2).cast("int")
    return _keyed(df, ("f", short, low + half, high, limit), ("r", short, low, high + half, F.least(limit, low + half)))


BLOCK_OF = ("short", "path", "shared")


def _near(part: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each row of whole blocks in order that has near words: their number and the most frequent, ties by name."""
    short, limit, long, n = (part.column(c).to_numpy() for c in ("short", "limit", "long", "n"))
    block = _starts(part).cumsum()
    words = np.array([w.encode("latin-1") for w in part.column("word").to_pylist()], object)
    for size in np.unique(short):
        rows = np.flatnonzero(short == size)
        width = int(size) + 1
        m = np.zeros((len(rows), width), np.uint8)
        m[np.arange(width) < (size + long[rows])[:, None]] = np.frombuffer(b"".join(words[rows]), np.uint8)
        own, ends, found = block[rows], long[rows], []
        i, step = np.arange(len(rows)), 1
        while len(i := i[i + step < len(rows)]) and len(i := i[own[i] == own[i + step]]):
            a = i[~(ends[i] & ends[i + step])]
            for k in range(0, len(a), most := max(1, AT_ONCE // width)):
                x, y = a[k : k + most], a[k : k + most] + step
                x, y = np.where(ends[x], y, x), np.where(ends[x], x, y)  # y is the longer, if any is
                off = m[x] != m[y]
                p = off.argmax(1)
                ahead = m[x, :-1] != m[y, 1:]
                tail = np.where(ahead.any(1), size - 1 - ahead[:, ::-1].argmax(1), -1)  # the last difference, the longer moved by one
                ok = np.where(ends[y], tail < p, off.sum(1) == 1) & (p < limit[rows[x]])
                found.append(np.stack([x[ok], y[ok]]))
            step += 1
        if not found or not (pairs := np.concatenate(found, 1)).size:
            continue
        me, you = rows[np.concatenate([pairs[0], pairs[1]])], rows[np.concatenate([pairs[1], pairs[0]])]
        place = np.empty(len(rows), int)
        place[np.argsort(words[rows], kind="stable")] = np.arange(len(rows))
        by = np.lexsort((place[np.searchsorted(rows, you)], -n[you], me))
        me, you = me[by], you[by]
        first = np.flatnonzero(np.r_[True, me[1:] != me[:-1]])
        yield pa.RecordBatch.from_arrays(
            [part.column("word").take(me[first]).combine_chunks(), pa.array(np.diff(np.r_[first, len(me)])), part.column("word").take(you[first]).combine_chunks(), pa.array(n[you[first]])],
            ["word", "n_near", "near", "near_n"],
        )


def _starts(part: pa.Table) -> np.ndarray:
    """True for each row whose block isn't that of the row before."""
    out = np.zeros(part.num_rows, bool)
    out[0] = True
    for c in BLOCK_OF:
        x = part.column(c).combine_chunks()
        out[1:] |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_near`` over rows that come in the order of their blocks; the block that a batch ends in waits for the next."""
    kept: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = pa.concat_tables([kept, part]) if kept is not None else part
        if part.num_rows:
            cut = int(np.flatnonzero(_starts(part))[-1])
            if cut:
                yield from _near(part.slice(0, cut))
            kept = part.slice(cut)
    if kept is not None and kept.num_rows:
        yield from _near(kept)
    release()


def neighbours(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows ``(word, n_near, near, near_n)`` for each word of ``vocabulary(word, n)``, all distinct, that has near words.

    ``n_near`` counts the words that differ by exactly one inserted, deleted or replaced code point; ``near`` is the one of
    largest n, ties by the smallest in code-point order. Words are of the characters up to U+00FF.
    """
    size, none = F.length("word"), F.lit(2**31 - 1)
    begin, at = vocabulary.select("word", "n", F.lit("").alias("path")), lambda x: F.floor(x / 2).cast("int")
    zero = F.lit(0)
    ways = [w for s in (size, size - 1) for w in (("f", s, at(s), zero, none), ("r", s, zero, at(s), at(s)))]
    level, parts = _keyed(begin, *ways), []
    key = F.xxhash64(*BLOCK_OF)
    while True:
        counts = level.groupBy(*BLOCK_OF, "low", "high").agg(F.count("*").alias("rows"))
        large = counts.where((F.col("rows") > block) & (F.col("short") - F.col("low") - F.col("high") > 1)).select(key.alias("_key")).distinct()
        large = written(large, "large-blocks")
        found = large.count()
        if not found:
            break
        # two blocks of one hash are both split, which changes no result
        side = F.broadcast(large) if found <= BROADCAST_ROWS else large.hint("merge")
        parts.append(level.join(side, key == F.col("_key"), "left_anti"))
        level = written(_split(level.join(side, key == F.col("_key"), "left_semi")), "blocks")
    for part in parts:
        level = level.unionByName(part)
    level = level.select("word", "n", *BLOCK_OF, "limit", "long")
    found = level.repartitionByRange(*BLOCK_OF).sortWithinPartitions(*BLOCK_OF).mapInArrow(_scan, "word string, n_near long, near string, near_n long")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.near", "best.near_n")


def _roots(links: DataFrame) -> DataFrame:
    """Rows ``(word, root)`` for ``links(word, form)``, by doubling: after k rounds a root is 2^k forms ahead, or the last."""
    now = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = written(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def variants(docs: DataFrame, length: int = LENGTH, least: int = LEAST, ratio: int = RATIO, planted: int = PLANTED, block: int = BLOCK) -> DataFrame:
    """Rows ``(word, n, n_near, form, form_n, root)``, one for each word of ``vocabulary``.

    ``n_near``: near words (see ``neighbours``), 0 if none. ``form``: the near word of largest n, if that is ``ratio`` times the
    word's n or more, else null; ``form_n`` its n. ``root``: the last of the word's form, its form's form and so on; the word
    itself if it has none. Nulls, empty texts and repeated rows: see ``vocabulary``. Empty tables give no rows; other columns
    don't matter.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    known = written(vocabulary(docs, length, least, planted), "words")
    near = written(known.join(neighbours(known, block), "word", "left"), "near-words")
    is_form = F.col("near_n") >= ratio * F.col("n")
    own = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    roots = _roots(own.where("form is not null"))
    return own.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


ORACLE = f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS crc
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT doc, run, count(*) AS n, doc || ':' || run AS s FROM runs WHERE length(run) >= {LENGTH} GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(s, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS bytes FROM c),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a // 256, crc[((xor(a, x) % 256) + 1)::INT])), 4294967295) AS h FROM b, tab),
w AS (SELECT CASE WHEN h % {PLANTED} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY ALL),
v AS (SELECT word, n FROM w WHERE length(word) >= {LENGTH} AND n >= {LEAST}),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.cut = v.word
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.cut = v.word),
g AS (SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY word),
k AS (SELECT g.word, g.n_near, g.m, min(p.near) AS near FROM g JOIN p ON p.word = g.word AND p.m = g.m GROUP BY ALL),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= {RATIO} * v.n THEN near END AS form, CASE WHEN m >= {RATIO} * v.n THEN m END AS form_n FROM v LEFT JOIN k USING (word)),
r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.at AS root FROM f JOIN r ON f.word = r.word JOIN f l ON r.at = l.word WHERE l.form IS NULL
"""
