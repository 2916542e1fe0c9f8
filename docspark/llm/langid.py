"""Language identification by segmentation-marginalised unigrams over a public vocabulary.

A language is a probability for each piece of the vocabulary. A text's letters are taken as lower-cased words with the
vocabulary's word-start mark; the likelihood of a word is the sum over all its segmentations into pieces, by the forward
algorithm, which is rescaled at each letter for words that are long, as their likelihoods are too small for a number; that of a text is the product over its words. A letter that
the vocabulary lacks is a piece of its own with one small probability. Training runs a few expectation-maximisation
steps (forward-backward, so again over all segmentations) on the words of one bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, ROWS_PER_LANGUAGE, STEPS, UNKNOWN = "▁", 400, 3, 1e-9
#: Words of more letters are long: they are scored with rescaling, and not remembered. Positions of one at a time.
LONG, PART = 32, 4096
#: There is a probability for each piece and language on the driver and on executors; beyond this many it refuses.
MOST_LANGUAGES = 1000
_RUN = re.compile(r"[^\W\d_]+")
_P = np.uint64(0x100000001B3)


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters of a text."""
    out = []
    for run in _RUN.findall((text or "").lower()):
        if not run.isalpha():
            run = "".join(c for c in run if c.isalpha())
        if run:
            out.append(run)
    return out


class Vocabulary:
    """Pieces and a vectorised search for them: polynomial hashes of code points, sorted."""

    def __init__(self, pieces: list[str]):
        self.pieces = sorted({p for p in pieces if p and (p[0] == MARK and p[1:].isalpha() or p.isalpha()) and p == p.lower()})
        h = np.array([self._hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(h)
        self.hashes, self.at = h[order], order
        self.longest = max(map(len, self.pieces), default=1)

    @staticmethod
    def _hash(p: str) -> int:
        h = 0
        for c in p:
            h = (h * int(_P) + ord(c) + 1) & (2**64 - 1)
        return h

    def find(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """For words of one length (rows of code points): start, end, and each word's piece there or -1 for none."""
        n, length = codes.shape
        codes = codes.astype(np.uint64) + np.uint64(1)
        for start in range(length):
            h = np.zeros(n, np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                h = h * _P + codes[:, end - 1]
                if not len(self.hashes):
                    yield start, end, np.full(n, -1)
                    continue
                i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                yield start, end, np.where(self.hashes[i] == h, self.at[i], -1)


def load(path: str) -> Vocabulary:
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    return Vocabulary([s.id_to_piece(i) for i in range(s.get_piece_size())])


def _behind(word: str, vocabulary: Vocabulary, back: bool = False) -> np.ndarray:
    """For each place of a marked word and each length the piece that ends there, as a row of ``_forward``'s table; ``back``: of the word read backwards.

    A single code point that the vocabulary lacks is the last row but one, other gaps the last, whose probability is 0.
    """
    codes = np.frombuffer((MARK + word).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n, none = len(codes), len(vocabulary.pieces) + 1
    out = np.full((n + 1, vocabulary.longest), none)
    h = np.zeros(n, np.uint64)
    for k in range(min(n, vocabulary.longest)):
        h = h[: n - k] * _P + codes[k:]
        at = np.minimum(np.searchsorted(vocabulary.hashes, h), max(0, len(vocabulary.hashes) - 1))
        found = vocabulary.hashes[at] == h if len(vocabulary.hashes) else np.zeros(len(h), bool)
        piece = np.where(found, vocabulary.at[at] if len(vocabulary.hashes) else 0, none - 1 if k == 0 else none)
        if back:
            out[n - np.arange(n - k), k] = piece
        else:
            out[k + 1 :, k] = piece
    return out


def _forward(behind: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Natural logs of the summed likelihoods of all segmentations up to each place of a word, one column for each language.

    The sums of the last places are kept relative to the newest, so they don't underflow at any length.
    """
    table = np.concatenate([p, np.zeros((1, p.shape[1]))])
    n, longest = behind.shape
    out = np.zeros((n, p.shape[1]))
    window = np.zeros((longest, p.shape[1]))  # the newest first
    window[0] = 1
    for part in range(1, n, PART):
        for t, w in enumerate(table[behind[part : part + PART]], part):
            new = (window * w).sum(axis=0)
            out[t] = out[t - 1] + np.log(new)
            window[1:] = window[:-1] / new
            window[0] = 1
    return out


def _by_length(known: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the words of each length that isn't long, and their code points behind the mark."""
    lengths = np.array([len(w) for w in known])
    for n in np.unique(lengths[lengths <= LONG]):
        at = np.flatnonzero(lengths == n)
        text = "".join(MARK + known[i] for i in at)
        yield at, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n + 1)


def likelihoods(known: list[str], vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Natural logs, one row for each word and one column for each language; ``p`` has a row for each piece and one more."""
    out = np.zeros((len(known), p.shape[1]))
    for i, w in enumerate(known):
        if len(w) > LONG:
            out[i] = _forward(_behind(w, vocabulary), p)[-1]
    for at, codes in _by_length(known):
        n, length = codes.shape
        alpha = np.zeros((length + 1, n, p.shape[1]))
        alpha[0] = 1
        for start, end, piece in vocabulary.find(codes):
            if end == start + 1:  # a single code point is always a piece; what is lacking is the last row
                alpha[end] += alpha[start] * p[piece]
            elif len(m := np.flatnonzero(piece >= 0)):
                alpha[end][m] += alpha[start][m] * p[piece[m]]
        out[at] = np.log(alpha[length])
    return out


def expected(known: list[str], times: np.ndarray, vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, for one language."""
    uses = np.zeros(len(p))
    table = np.append(p, 0.0)
    for w, k in zip(known, times):
        if len(w) > LONG:
            behind, back = _behind(w, vocabulary), _behind(w, vocabulary, True)
            alpha, beta = _forward(behind, p[:, None])[:, 0], _forward(back, p[:, None])[::-1, 0]
            for size in range(1, min(len(alpha), behind.shape[1] + 1)):
                piece = behind[size:, size - 1]
                ok = piece < len(p)
                share = np.exp(alpha[:-size][ok] + np.log(table[piece[ok]]) + beta[size:][ok] - alpha[-1])
                uses += np.bincount(piece[ok], k * share, len(p))
    for at, codes in _by_length(known):
        n, length = codes.shape
        spans = list(vocabulary.find(codes))
        alpha, beta = np.zeros((length + 1, n)), np.zeros((length + 1, n))
        alpha[0], beta[length] = 1, 1
        ok = lambda start, end, piece: (piece >= 0) | (end == start + 1)
        for start, end, piece in spans:
            alpha[end] += alpha[start] * p[piece] * ok(start, end, piece)
        for start, end, piece in reversed(spans):
            beta[start] += beta[end] * p[piece] * ok(start, end, piece)
        for start, end, piece in spans:
            w = alpha[start] * p[piece] * beta[end] * ok(start, end, piece) / alpha[length] * times[at]
            uses += np.bincount(np.where(piece >= 0, piece, len(p) - 1), w, len(p))
    return uses


class Model:
    def __init__(self, vocabulary: str, languages: list[str], p: np.ndarray):
        self.vocabulary, self.languages, self.p = vocabulary, languages, p


def fit(counts: dict[str, Counter], vocabulary: str, steps: int = STEPS) -> Model:
    """From each language's word counts; ``vocabulary`` is the path of a sentencepiece model."""
    v, languages = load(vocabulary), sorted(counts)
    columns = []
    for lang in languages:
        known = sorted(counts[lang])
        times = np.array([counts[lang][w] for w in known], float)
        p = np.array([*(10.0 ** -len(x) for x in v.pieces), UNKNOWN])
        for _ in range(steps):
            uses = expected(known, times, v, p) if known else np.zeros(len(p))
            p = (uses + 0.01) / (uses.sum() + 0.01 * len(p))
            p[-1] = UNKNOWN
        columns.append(p)
    return Model(vocabulary, languages, np.stack(columns, axis=1) if columns else np.zeros((len(v.pieces) + 1, 0)))


class Scorer:
    """Scores texts; remembers words, within a bound."""

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.vocabulary, self.most, self.known = model, load(model.vocabulary), most, {}
        self.rows = np.zeros((0, len(model.languages)))

    def _learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > self.most:
            self.known, self.rows = {}, self.rows[:0]
        found = [likelihoods(new[i : i + 20_000], self.vocabulary, self.model.p) for i in range(0, len(new), 20_000)]
        self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.rows = np.concatenate([self.rows, *found])

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language and its posterior share for each text; ``und`` and 0 where a text has no letter."""
        lang, score = [], []
        for i in range(0, len(texts), 256):
            cut = [words(t) for t in texts[i : i + 256]]
            every = {w for own in cut for w in own if len(w) <= LONG}
            if new := sorted(every.difference(self.known)):
                if len(self.known) + len(new) > self.most:
                    new = sorted(every)
                self._learn(new)
            for w in cut:
                if not w or not self.model.languages:
                    lang.append("und")
                    score.append(0.0)
                    continue
                long = [x for x in w if len(x) > LONG]
                short = w if not long else [x for x in w if len(x) <= LONG]
                log = self.rows[np.fromiter(map(self.known.__getitem__, short), np.int64, len(short))].sum(axis=0)
                for x, k in Counter(long).items():
                    log = log + k * likelihoods([x], self.vocabulary, self.model.p)[0]
                best = int(log.argmax())
                lang.append(self.model.languages[best])
                score.append(float(1 / np.exp(log - log[best]).sum()))
        return lang, score


def train(rows: DataFrame, vocabulary: str, per_language: int = ROWS_PER_LANGUAGE, steps: int = STEPS) -> Model:
    """From ``rows(doc_id, text, lang)`` with a lang; null or empty texts teach nothing.

    The sample, documented bound: about ``per_language`` rows of each language, drawn by a hash of doc_id (all, where
    there are fewer). Its word counts go to the driver.
    """
    rows = rows.where("lang is not null")
    n = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(n) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; a model has a column for each")
    share = F.lit(0.0)
    for lang, k in n.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / k))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("lang")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                counts.setdefault(lang, Counter()).update(words(text))
        for lang, c in counts.items():
            yield pd.DataFrame({"lang": lang, "word": list(c), "n": list(c.values())})

    some = rows.where(draw < share).select("lang", "text").mapInPandas(of, "lang string, word string, n long")
    counts: dict[str, Counter] = {lang: Counter() for lang in n}
    got = some.groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    for lang, part in got.groupby("lang"):
        counts[lang] = Counter(dict(zip(part["word"], part["n"].tolist())))
    return fit(counts, vocabulary, steps)


def fold(doc_id, of: int):
    return F.crc32(doc_id.cast("string")) % of


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, one row for each row; repeated rows get the same.

    Columns of ``docs`` that are called so give way; others stay, whatever their names. Texts are scored whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # pieces of the vocabulary x languages

    @F.pandas_udf("lang_pred string, score double")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for texts in parts:
            lang, score = scorer.score(texts.tolist())
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    kept = F.struct(*[f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score")]).alias("own")
    return docs.select(kept, found("text").alias("p")).select("own.*", "p.lang_pred", "p.score")


def identified(docs: DataFrame, vocabulary: str, folds: int = 4, held: int = 2, **how) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``; nothing is learned from the held-out fold.

    Rows whose doc_id is null are held out. If no row has a language, every prediction is ``und``. A column ``held_out`` of
    ``docs`` gives way.
    """
    is_held = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(True))
    model = train(docs.where(~is_held).select("doc_id", "text", "lang"), vocabulary, **how)
    return predict(docs.withColumn("held_out", is_held), model)
