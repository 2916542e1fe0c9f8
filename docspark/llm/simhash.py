"""SimHash near-duplicates: vantage-point trees over 64-bit fingerprints, exact pairs within a Hamming radius.

Fingerprint. A-Z are lower-cased, words are runs without ASCII white space, shingles are ``width`` words joined by a
space, repeats included (fewer words: the whole sequence is one shingle; none: fingerprint zero, linked like any other;
a null text is an empty one). Bit i is 1 if over half of the shingles' XXH64 values (seed 42) have it set.

Search. A forest of vantage-point trees. Each tree has a share of the bits: with three trees and radius 4, a pair at 4 or
fewer differing bits differs in at most one bit of some tree's share, so that is the tree's radius. A tree's levels take a
group of its bits each, and a node's branches are the Hamming distances, over that group, from the level's vantage point.
By the triangle inequality two fingerprints at distance d over a group have distances from the vantage point that
are at most d apart, and groups add up; so a branch whose distances differ from a fingerprint's by more than the tree's
radius in all, level by level, is pruned. A leaf is a shard, named by its distances. A fingerprint is stored in its own
shard and asks in each shard whose border lies within its radius; as pairs go both ways, only in those after its own.
There all 64 bits are compared. Trees are as deep as the number of fingerprints asks for.

A shard of more than ``leaf`` rows is dealt over blocks: each block is searched together with the shard's most common
fingerprint, and after that only fingerprints that don't belong to the shard's main component meet the other blocks.
So every pair is compared or already connected, and no task holds a large shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import components, written

WIDTH, RADIUS = 4, 4
#: Trees, fingerprints that a shard should hold if they were evenly spread, rows of a shard from which on it is dealt over blocks.
TREES, SHARD, LEAF = 3, 64, 4096


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space are touched
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]])
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    at = list(zip(starts.tolist(), (ends[len(words) - n :] - 1).tolist()))
    for i in range(0, n, 65536):
        part = b"".join([digest(joined[a:b], 42) for a, b in at[i : i + 65536]])
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def _fingerprints(width: int):
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return of


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows ``(doc_id, fp long)``, one for each row of ``docs``."""
    return docs.select("doc_id", _fingerprints(width)("text").alias("fp"))


def _cuts(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    cuts = [low + (high - low) * i // parts for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def _offsets(levels: int, radius: int) -> list[tuple[int, ...]]:
    """Gaps of distances, level by level, of ``radius`` or less in all; of each and its opposite, the one that goes up first."""
    out = [((), radius)]
    for _ in range(levels):
        out = [((*o, g), left - abs(g)) for o, left in out for g in range(-left if any(o) else 0, left + 1)]
    return [o for o, _ in out if any(o)]


class Tree:
    """Levels of one tree: for each a group of bits and a vantage point; see the module's text."""

    def __init__(self, low: int, high: int, levels: int, radius: int, seed: int):
        self.radius, groups = radius, _cuts(low, high, levels)
        self.masks = np.array([(1 << b) - (1 << a) for a, b in groups], np.uint64)
        self.vantage = np.random.default_rng(seed).integers(0, 2**64, levels, dtype=np.uint64) & self.masks
        self.most = np.array([b - a for a, b in groups], np.int64)
        self.strides = np.concatenate([[1], np.cumprod(self.most + 1)[:-1]]).astype(np.int64)
        self.offsets = np.array(_offsets(levels, radius), np.int64).reshape(-1, levels)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.bitwise_count((x[:, None] ^ self.vantage) & self.masks).astype(np.int64)

    def shards(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in ``x`` and their shards: first where each is stored, then where it asks."""
        d = self.distances(x)
        own = d @ self.strides
        yield np.arange(len(x)), own
        for o in self.offsets:
            at = np.flatnonzero(((d + o >= 0) & (d + o <= self.most)).all(axis=1))  # no such branch otherwise
            yield at, own[at] + int(o @ self.strides)


def _alike(bits: int) -> float:
    """The chance that two even fingerprints have the same distance over so many bits."""
    return sum(comb(bits, k) ** 2 for k in range(bits + 1)) / 4.0**bits


def planted(n: int, radius: int = RADIUS, trees: int = TREES, shard: int = SHARD) -> list[Tree]:
    """Trees for ``n`` fingerprints: of as few levels as leave about ``shard`` of them in a shard; one bit a level at most."""
    out = []
    for t, (low, high) in enumerate(_cuts(0, 64, trees)):
        levels = next((g for g in range(1, high - low) if n * np.prod([_alike(b - a) for a, b in _cuts(low, high, g)]) <= shard), high - low)
        out.append(Tree(low, high, levels, radius // trees, 20 + t))
    return out


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    out = np.empty((len(a), len(b)), bool)
    for i in range(0, len(a), 256):
        out[i : i + 256] = np.bitwise_count(a[i : i + 256, None] ^ b[None, :]) <= radius
    return out


def forest(x: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked at ``radius`` or fewer differing bits: stored ones with each other and with asking ones."""
    own, other = x[~asks], x[asks]
    adj, src, dst, label = near(own, own, radius), [], [], np.arange(len(own))
    np.fill_diagonal(adj, False)
    free = adj.any(axis=1)
    while len(start := np.flatnonzero(free)):
        free[root := int(start[0])] = False
        queue = [root]
        while queue:
            got = np.flatnonzero(adj[i := queue.pop()] & free)
            if len(got):
                free[got], label[got] = False, root
                queue += got.tolist()
                src += [i] * len(got)
                dst += got.tolist()
    a, b = [own[src]], [own[dst]]
    if len(own) and len(other):
        u, v = np.nonzero(near(own, other, radius))
        _, one = np.unique(label[u] * len(other) + v, return_index=True)  # one edge for each component and asking one
        a.append(own[u[one]])
        b.append(other[v[one]])
    return np.concatenate(a), np.concatenate(b)


def _runs(keys: list[str]):
    """Whole runs of rows with equal ``keys`` from sorted batches."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[list[pd.DataFrame]]:
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            k = pdf[keys].to_numpy()
            if not len(k):
                continue
            at = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            cuts = [0, *at.tolist()]
            yield [pdf.iloc[a:b] for a, b in zip(cuts, cuts[1:]) if b - a > 1]
            held = pdf.iloc[cuts[-1] :]
        if held is not None and len(held) > 1:
            yield [held]

    return of


def _search(radius: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for runs in _runs(["tree", "shard", "block"])(batches):
            found = [forest(r["fp"].to_numpy().view(np.uint64), r["asks"].to_numpy(), radius) for r in runs]
            if found:
                a, b = (np.concatenate(z).view(np.int64) for z in zip(*found))
                yield pd.DataFrame({"a": a, "b": b})

    return of


def _search_rest(radius: int):
    """In a block of a large shard: fingerprints outside the main component against all of another component."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for runs in _runs(["tree", "shard", "block"])(batches):
            for r in runs:
                x, label, rest, asks = r["fp"].to_numpy().view(np.uint64), r["label"].to_numpy(), r["rest"].to_numpy(), r["asks"].to_numpy()
                y, y_label, y_asks = x[rest], label[rest], asks[rest]
                for i in range(0, len(y), 512):
                    apart = (y_label[i : i + 512, None] != label[None, :]) & ~(y_asks[i : i + 512, None] & asks[None, :])
                    u, v = np.nonzero(near(y[i : i + 512], x, radius) & apart)
                    # one edge for each pair of a fingerprint and a component is enough
                    e = pd.DataFrame({"a": y[i : i + 512][u].view(np.int64), "b": x[v].view(np.int64), "c": label[v]})
                    yield e.drop_duplicates(["a", "c"])[["a", "b"]]

    return of


def spread(unique: DataFrame, trees: list[Tree]) -> DataFrame:
    """Rows ``(tree, shard, asks, fp, n)``: where each of ``unique(fp, n)`` is stored and where it asks."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, n = pdf["fp"].to_numpy(), pdf["n"].to_numpy()
            for t, tree in enumerate(trees):
                for k, (at, shard) in enumerate(tree.shards(x.view(np.uint64))):
                    yield pd.DataFrame({"tree": np.int32(t), "shard": shard, "asks": k > 0, "fp": x[at], "n": n[at]})

    return unique.select("fp", "n").mapInPandas(of, "tree int, shard long, asks boolean, fp long, n long")


def links(unique: DataFrame, radius: int = RADIUS, leaf: int = LEAF, n: int | None = None) -> DataFrame:
    """Components of ``unique(fp long, n long)``, distinct fingerprints linked at ``radius`` or fewer differing bits.

    Rows ``(node, root)`` for the linked ones, root the smallest (signed) fingerprint reachable.
    """
    rows = spread(unique, planted(unique.count() if n is None else n, radius))
    key = ["tree", "shard"]
    large = rows.groupBy(*key).agg(F.count("*").alias("size"), F.max_by("fp", F.struct("n", "fp")).alias("hub")).where(F.col("size") > leaf)
    large = written(large.withColumn("blocks", F.ceil(F.col("size") / leaf).cast("int")), "large-shards")  # at most rows / leaf of them
    has_large = bool(large.take(1))
    block = F.lit(0)
    if has_large:
        rows = rows.join(large.select(*key, "hub", "blocks"), key, "left")
        block = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        rows = rows.where("blocks is null or fp <> hub")
    dealt = rows.select(*key, block.alias("block"), "asks", "fp")
    if has_large:
        hubs = large.select(*key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asks"), F.col("hub").alias("fp"))
        dealt = dealt.unionByName(hubs)
    dealt = dealt.repartition(*key, "block").sortWithinPartitions(*key, "block")
    edges = written(dealt.mapInPandas(_search(radius), "a long, b long").distinct(), "links")
    found = components(edges)
    if not has_large:
        return found
    # pairs across the blocks of a large shard
    inside = spread(unique, planted(unique.count() if n is None else n, radius)).join(large.select(*key, "blocks"), key)
    inside = inside.join(found, inside["fp"] == found["node"], "left").select(*key, "blocks", "asks", "fp", F.coalesce("root", "fp").alias("label"))
    inside = written(inside, "large-members")
    main = inside.groupBy(*key, "label").count().groupBy(*key).agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    inside = inside.join(main, key)
    own = inside.select(*key, F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"), "asks", "fp", "label", F.lit(False).alias("rest"))
    rest = inside.where("label <> main").select(*key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "asks", "fp", "label", F.lit(True).alias("rest"))
    if not rest.take(1):
        return found
    more = own.unionByName(rest).repartition(*key, "block").sortWithinPartitions(*key, "block").mapInPandas(_search_rest(radius), "a long, b long")
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def _rooted(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """Written tables: ``(doc_id, hash, fp)``, a row for each of ``docs``, and ``(fp, low, root)``, low the smallest doc_id of fp."""
    prints = written(docs.select("doc_id", F.xxhash64("text").alias("hash"), _fingerprints(width)("text").alias("fp")), "fingerprints")
    unique = written(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")), "unique")
    found = links(unique, radius, leaf)
    named = unique.join(found, unique["fp"] == found["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return prints, written(named, "roots")


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """Rows ``(doc_id, fp long, fingerprint string, component_id)``, one for each row of ``docs(doc_id, text, ...)``.

    component_id is the smallest doc_id reachable over links, itself included; null doc_ids count for nothing there, and
    a group of them alone has a null component_id. Repeated rows give repeated rows. An empty table gives none.
    """
    prints, named = _rooted(docs, width, radius, leaf)
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = named.join(lowest, "root").select("fp", "component_id")
    out = prints.join(ids, "fp")
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without near-duplicates: of each component one row stays, that of its smallest doc_id.

    Null doc_ids come last; rows of one doc_id go by their texts' hashes, then by the hashes of the whole rows. All columns
    stay, whatever their names; rows with null or empty texts are copies of each other.
    """
    prints, named = _rooted(docs, **how)
    rows = prints.join(named.select("fp", "root"), "fp").groupBy("root", "doc_id", "hash").agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("doc_id", "hash", "n"), F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("x")
    keep = written(rows.groupBy("root").agg(best).select(F.col("x.doc_id").alias("_id"), F.col("x.hash").alias("_hash"), "x.n"), "kept")
    on = F.expr("own.doc_id <=> keep._id AND xxhash64(own.text) = keep._hash")
    only = lambda some: docs.alias("own").join(some.alias("keep"), on, "left_semi")
    repeated = keep.where("n > 1")
    if not repeated.take(1):
        return only(keep)
    whole = F.struct("*")
    first = only(repeated).groupBy("doc_id", F.xxhash64("text").alias("hash")).agg(F.min_by(whole, F.xxhash64(whole)).alias("row")).select("row.*")
    return only(keep.where("n = 1")).unionByName(first)
