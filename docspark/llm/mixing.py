"""Mixing sources to target weights, over fixed-length blocks of words.

Each source is one stream of words, which are the tokens here: its documents in a fixed order, cut into blocks of ``block``
words (the last may be shorter). A target turns into a whole number of block slots. The output has shards of ``shard``
slots; a shard's counts by source are a multinomial draw, made under the condition that all shards together use each
source's slots exactly, so targets are met. That makes it a multivariate hypergeometric draw: the slots of a range of shards
are split between its halves, and a shard follows its own path from the whole down. Every draw is seeded by its place in
that tree, so a shard needs no other shard, and reruns and retries agree. Draws are by rejection from a ratio of uniforms,
at every size; counts are exact whole numbers. A slot's number within its source is mapped to a block by a keyed
pseudorandom permutation of the source's block numbers, a new one for each pass over the source; then blocks are joined
by number.

The stream order is by bucket (a hash of doc_id), then doc_id, size and a hash of the text. There is a bucket for
``BUCKET_WORDS`` words of all sources, so a hot source is dealt over many tasks; buckets' totals are added up in a
second, small step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import WORD, written

BLOCK, SHARD, BUCKET_WORDS, SEED = 128, 4096, 1_000_000, 7
#: Sources are a handful in a mix; their names, weights and targets are on the driver. Beyond this many it refuses.
MOST_SOURCES = 100_000


def shares(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Targets by weight that add up to ``total``, none above ``most`` times its size; the excess is reshared by weight.

    If all are at their limit, they add up to less.
    """
    out, open_, left = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0], float(total)
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a pseudorandom permutation of 0..n-1 sends ``x``: a four-round Feistel network, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    h = np.uint64(half)
    keys = np.random.default_rng(key).integers(1, 2**63, 4, dtype=np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> h, v & low
        for k in keys:
            m = (b + k) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ (((m ^ (m >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(33)) & low
        return a << h | b

    v = once(x.astype(np.uint64))
    while (out := v >= np.uint64(n)).any():
        v[out] = once(v[out])
    return v.astype(np.int64)


# Fixed values of the ratio-of-uniforms method: 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e).
_WIDTH, _SHIFT = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)


def _log_ratio(k: int, m: int) -> tuple[int, float]:
    """ln(k! / m!) without (k - m) ln m: k - m and the rest, which is exact to a few ulps however large k and m are."""
    if k < 40 or m < 40:
        return 0, math.lgamma(k + 1) - math.lgamma(m + 1)
    d, tail = k - m, lambda x: 1 / (12 * x) - 1 / (360 * x**3)
    return d, (k + 0.5) * math.log1p(d / m) - d + tail(k) - tail(m)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` things drawn without putting back are of the ``good`` ones; exact for whole numbers of any size."""
    if min(good, bad, n, good + bad - n) <= 0:
        return min(good, n) if bad == 0 or n >= good + bad else 0 if good == 0 or n == 0 else good
    total = good + bad
    small, large, m = min(good, bad), max(good, bad), min(n, total - n)
    share = small / total
    centre = m * share + 0.5
    spread = _WIDTH * math.sqrt((total - m) * m * share * (1 - share) / (total - 1) + 0.5) + _SHIFT
    mode = (m + 1) * (small + 1) // (total + 2)
    at = (mode, small - mode, m - mode, large - m + mode)

    def log_odds(k: int) -> float:
        """ln of the chance of k over that of the mode."""
        out = 0.0
        for a, b in zip(at, (k, small - k, m - k, large - m + k)):
            d, rest = _log_ratio(b, a)
            out -= rest + (d * math.log(a) if d else 0.0)
        return out

    low, high = max(0, m - large), min(m, small)
    while True:
        u, v = rng.random(), rng.random()
        x = centre + spread * (v - 0.5) / u if u else -1.0
        if low <= x < high + 1 and 2 * math.log(u) <= log_odds(k := int(x)):
            break
    k = k if good <= bad else m - k
    return k if m == n else good - k


def _split(counts: list[int], n: int, seed: list[int]) -> list[int]:
    """``n`` of the slots in ``counts`` drawn without putting back: source by source, from what is left."""
    rng, left, out = np.random.default_rng(seed), sum(counts), []
    for c in counts:
        out.append(hypergeometric(rng, c, left - c, n))
        left, n = left - c, n - out[-1]
    return out


def shard_counts(quota: list[int], size: int, shard: int, seed: int = SEED) -> tuple[list[int], list[int]]:
    """First slot number and count for each source in a shard. ``quota``: slots of each source; ``size``: slots a shard."""
    low, high, start, counts = 0, -(-sum(quota) // size), [0] * len(quota), list(quota)
    while high - low > 1:
        middle = (low + high) // 2
        left = _split(counts, (middle - low) * size, [seed, low, high])
        if shard < middle:
            counts, high = left, middle
        else:
            start, counts, low = [a + b for a, b in zip(start, left)], [a - b for a, b in zip(counts, left)], middle
    return start, counts


def n_words(text) -> F.Column:
    """Words of a text; of a null text 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Mix:
    """The plan of a mix of ``docs(doc_id, text, source)``.

    ``weights(names)`` gives a weight for each source name, which come by code point, null last. There is one weight for
    each source, so the driver holds the sources, their sizes and targets (see ``MOST_SOURCES``); all else is tables:

    placed: doc_id, sid, size, tkey, bucket, seq, at - each document's place in its source's stream (rows, one for each row)
    slots(): shard, slot, sid, pass, block - the mix, in order
    spans(): placed's keys with shard, slot, pass, at, from_word, n_words - the words that each slot takes from each document
    """

    def __init__(self, docs: DataFrame, weights=None, share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard: int = SHARD, bucket_words: int = BUCKET_WORDS, seed: int = SEED):
        self.spark, self.block, self.shard, self.seed = docs.sparkSession, block, shard, seed
        light = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tkey")), "mix-sizes")
        found = light.groupBy("source").agg(F.sum("size")).limit(MOST_SOURCES + 1).collect()
        if len(found) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources; a mix has one weight for each")
        totals = {r[0]: r[1] for r in found}
        self.names = sorted((x for x in totals if x is not None), key=lambda x: [ord(c) for c in x]) + [None] * (None in totals)
        self.sizes = [totals[x] for x in self.names]
        self.weights = weights(self.names) if weights else [(3, 1, 2)[i % 3] for i in range(len(self.names))]
        self.targets = shares(self.sizes, self.weights, share * sum(self.sizes), most)
        self.blocks = [-(-n // block) for n in self.sizes]
        # a slot holds the source's mean block; a short last block so weighs what it holds
        self.quota = [min(int(most * b), round(t * b / n)) if n else 0 for n, b, t in zip(self.sizes, self.blocks, self.targets)]
        self.sources = self.spark.createDataFrame(list(enumerate(self.names)), "sid int, name string")
        buckets = max(256, sum(self.sizes) // bucket_words)
        light = light.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)).cast("int"))
        light = light.join(F.broadcast(self.sources), F.col("source").eqNullSafe(F.col("name")))
        place = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size", "tkey")
        light = light.withColumn("before", F.coalesce(F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        light = light.withColumn("seq", F.row_number().over(place))
        light = written(light.select("doc_id", "sid", "size", "tkey", "bucket", "seq", "before"), "mix-places")
        filled = light.groupBy("sid", "bucket").agg(F.sum("size").alias("filled"))  # a row for each bucket of a source
        filled = filled.withColumn("first", F.sum("filled").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("filled"))
        self.placed = light.join(filled.drop("filled"), ["sid", "bucket"]).withColumn("at", F.col("first") + F.col("before")).drop("first", "before")

    def slots(self) -> DataFrame:
        quota, n_blocks, size, seed = self.quota, self.blocks, self.shard, self.seed

        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for s in (int(s) for pdf in batches for s in pdf["id"]):
                start, counts = shard_counts(quota, size, s, seed)
                order = np.random.default_rng([seed, 1, s]).permutation(sum(counts))
                parts = []
                for sid in np.flatnonzero(counts):
                    number = np.arange(start[sid], start[sid] + counts[sid], dtype=np.int64)
                    turn, block = number // n_blocks[sid], np.zeros(len(number), np.int64)
                    for t in np.unique(turn):
                        m = turn == t
                        block[m] = permuted(number[m] % n_blocks[sid], n_blocks[sid], hash((seed, int(sid), int(t))) & (2**62 - 1))
                    parts.append(pd.DataFrame({"sid": np.int32(sid), "pass": turn.astype(np.int32), "block": block}))
                if parts:
                    out = pd.concat(parts, ignore_index=True)
                    out.insert(0, "shard", s)
                    out.insert(1, "slot", order)
                    yield out

        shards = -(-sum(self.quota) // size)
        return self.spark.range(0, shards, 1, max(1, min(shards, 4096))).mapInPandas(of, "shard long, slot long, sid int, pass int, block long")

    def cut(self) -> DataFrame:
        """``placed`` by block: a row for each document and block that holds some of its words."""
        last = F.floor((F.col("at") + F.col("size") - 1) / self.block)
        each = self.placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / self.block), last)))
        a = F.greatest(F.col("block") * self.block, F.col("at"))
        b = F.least((F.col("block") + 1) * self.block, F.col("at") + F.col("size"))
        return each.withColumn("from_word", a - F.col("at")).withColumn("n_words", b - a)

    def spans(self) -> DataFrame:
        # hints, as the slots' number isn't in the statistics: it grows with the data, so neither side is broadcast
        return self.cut().join(self.slots().hint("merge"), ["sid", "block"])

    def by_document(self) -> DataFrame:
        """A row for each row of the documents: doc_id, size, source_size, target, taken."""
        times = self.slots().groupBy("sid", "block").agg(F.count("*").alias("times"))
        took = self.cut().join(times.hint("merge"), ["sid", "block"]).groupBy("sid", "bucket", "seq").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
        known = self.spark.createDataFrame(list(zip(range(len(self.names)), self.sizes, map(float, self.targets))), "sid int, source_size long, target double")
        out = self.placed.join(took.hint("merge"), ["sid", "bucket", "seq"], "left").join(F.broadcast(known), "sid")
        return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_sizes(docs: DataFrame, **how) -> DataFrame:
    """Rows ``(doc_id, size, source_size, target, taken)``, one for each row of ``docs(doc_id, text, source)``.

    A null or empty text has size 0 and gives nothing; a null source is a source. Repeated rows each have a place. An
    empty table gives no rows.
    """
    return Mix(docs, **how).by_document()


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def word_borders(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word of a UTF-8 text, and the byte after it."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_SPACES[np.frombuffer(text, np.uint8)]
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ``(text, sid, found)``, found a list of (place, at, from_word, n_words): a row for each, with its words."""
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            rows, out = batch.slice(k, 256), []
            for text, sid, found in zip(rows.column(0), rows.column(1).to_pylist(), rows.column(2)):
                text = text.as_buffer().to_pybytes()
                starts, ends = word_borders(text)
                for p in found.as_py():
                    a, b = p["from_word"], p["from_word"] + p["n_words"] - 1
                    out.append((p["place"], sid, p["at"], text[starts[a] : ends[b]]))
            places, sids, at, words = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(sids, pa.int32()), pa.array(at, pa.int64()), pa.array(words, pa.binary()).cast(pa.string())], names=["place", "sid", "at", "words"])


def packed_blocks(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows ``(place, source, text, n_words)``, one for each slot, its block's words in stream order.

    ``place`` is the shard times slots a shard, plus the slot: the order of the mix. ``text`` holds the words with the white
    space between them; parts of two documents are joined by a newline. Null and empty texts give nothing, repeated rows
    each have their own words, an empty table gives no rows. ``docs`` may have any other columns.
    """
    return _packed(docs, Mix(docs, **how))


def _packed(docs: DataFrame, mix: Mix) -> DataFrame:
    key = ["_doc", "_source", "_tkey"]
    # one list for each row of the documents, as long as the document; its keys are the row's doc_id, source and text
    found = mix.spans().withColumn("_place", F.col("shard") * mix.shard + F.col("slot"))
    piece = F.struct(F.col("_place").alias("place"), F.col("at"), F.col("from_word"), F.col("n_words"))
    found = found.groupBy("doc_id", "sid", "tkey", "bucket", "seq").agg(F.collect_list(piece).alias("_found"))
    found = found.join(F.broadcast(mix.sources), "sid").select(F.col("doc_id").alias("_doc"), F.col("name").alias("_source"), F.col("tkey").alias("_tkey"), "sid", "_found")
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.xxhash64("text").alias("_tkey"), "text")
    # rows alike in all of these have alike words: one text serves them all
    repeated = written(mix.placed.groupBy("doc_id", "sid", "tkey").agg(F.count("*").alias("n")).where("n > 1").join(F.broadcast(mix.sources), "sid").select(F.col("doc_id").alias("_doc"), F.col("name").alias("_source"), F.col("tkey").alias("_tkey")), "mix-repeated")
    same = lambda a, b: F.expr(" AND ".join(f"{a}.{k} <=> {b}.{k}" for k in key))
    if repeated.take(1):
        once = texts.alias("t").join(repeated.alias("r"), same("t", "r"), "left_semi").dropDuplicates(key)
        texts = texts.alias("t").join(repeated.alias("r"), same("t", "r"), "left_anti").unionByName(once)
    pieces = texts.alias("t").join(found.alias("f"), same("t", "f")).select("text", "sid", "_found").mapInArrow(_pieces, "place long, sid int, at long, words string")
    blocks = pieces.groupBy("place", "sid").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("w"))  # a place has one source
    out = blocks.join(F.broadcast(mix.sources), "sid").select("place", F.col("name").alias("source"), F.array_join("w.words", "\n").alias("text"))
    return out.withColumn("n_words", n_words(F.col("text")))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``packed_blocks`` with the columns of ``docs``, to go on with: a block is a document, in the order of the mix.

    doc_id is the block's place, ``source`` its source, ``text`` its words, ``n_chars`` (if there is such a column) their
    length. Any other column says something of single documents and is null.
    """
    blocks = packed_blocks(docs, **how)
    own = {"doc_id": F.col("place"), "source": F.col("source"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return blocks.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
