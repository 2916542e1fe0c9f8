"""Token ids in length-delimited binary records, with an index of offsets for shuffled reads.

A data file is a run of frames. A frame is: payload length (uint64), masked checksum of these 8 bytes (uint32), the
payload, masked checksum of the payload (uint32); all little-endian. The checksum is CRC-32C with the usual mask, rotated
right by 15 bits plus a constant, so readers of such record files can read them. A payload is one document: a flag byte
(bit 0: doc_id present, bit 1: ids are 4 bytes wide, else 2), doc_id (int64, 0 if absent), the ids. The index file of a
data file, which ends in ``.index``, has one uint64 for each frame, its offset. Files are numbered in the order of the
documents they hold.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import by_size, kept, new_path, release

END_ID = 1
#: Text that is split into pieces at once, words that an encoder remembers, tasks that read files, bytes read at once.
CHUNK, WORDS, READERS, READ = 4_000_000, 250_000, 10_000, 8_000_000

# Fixed values of CRC-32C: the polynomial, least significant bit first, and the mask's constant.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
_BLOCK = 64


@lru_cache
def _tables() -> np.ndarray:
    """For each byte of a block, what each of its values adds to the block's checksum."""
    t = np.zeros((_BLOCK, 256), np.uint32)
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> 1) ^ np.where(c & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    t[0] = c
    for k in range(1, _BLOCK):
        t[k] = (t[k - 1] >> 8) ^ t[0][t[k - 1] & 0xFF]
    return t[::-1].copy()


@lru_cache
def _behind(level: int) -> np.ndarray:
    """What each byte of a checksum becomes when 2**level blocks of zeros follow."""
    if level:
        half = _behind(level - 1)
        step = lambda x: half[0][x & 0xFF] ^ half[1][x >> 8 & 0xFF] ^ half[2][x >> 16 & 0xFF] ^ half[3][x >> 24]
        return np.stack([step(half[i]) for i in range(4)])
    one, out = _tables()[-1], np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    for _ in range(_BLOCK):
        out = (out >> 8) ^ one[out & 0xFF]
    return out


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each of ``parts``: blocks at once by tables, then neighbouring blocks are combined, level by level."""
    if not parts:
        return np.zeros(0, np.uint32)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    n = np.maximum(1, -(-sizes // _BLOCK))
    ends = np.cumsum(n) * _BLOCK
    padded = np.zeros(int(ends[-1]), np.uint8)  # zeros in front change nothing
    for p, end, k in zip(parts, ends.tolist(), sizes.tolist()):
        if k:
            padded[end - k : end] = np.frombuffer(p, np.uint8)
            padded[end - k : end - k + 4] ^= 0xFF if k >= 4 else 0
    out, t = np.zeros(len(padded) // _BLOCK, np.uint32), _tables()
    for j, column in enumerate(padded.reshape(-1, _BLOCK).T):
        out ^= t[j][column]
    level = 0
    while (n > 1).any():
        odd = n & 1
        all_ = np.zeros(int((n + odd).sum()), np.uint32)
        starts = np.cumsum(n + odd) - (n + odd) + odd
        all_[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(len(out))] = out
        b, left = _behind(level), all_[0::2]
        out = b[0][left & 0xFF] ^ b[1][left >> 8 & 0xFF] ^ b[2][left >> 16 & 0xFF] ^ b[3][left >> 24] ^ all_[1::2]
        n, level = (n + odd) // 2, level + 1
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes < 4):
        c = 0xFFFFFFFF
        for x in parts[i]:
            c = (c >> 8) ^ int(_tables()[-1][(c ^ x) & 0xFF])
        out[i] = c ^ 0xFFFFFFFF
    return out


def masked(parts: list[bytes]) -> np.ndarray:
    crc = crc32c(parts)
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK)


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(heads).astype("<u4"), masked(payloads).astype("<u4")
    return [b"".join((h, x.tobytes(), p, y.tobytes())) for h, x, p, y in zip(heads, a, payloads, b)]


def unframe(data: bytes, offsets: list[int]) -> list[bytes]:
    """The payloads of the frames at ``offsets`` of ``data``; raises ValueError if a checksum or a length doesn't hold."""
    heads = [data[a : a + 8] for a in offsets]
    if any(len(h) < 8 for h in heads):
        raise ValueError("a frame is cut off")
    stored = np.array([struct.unpack("<I", data[a + 8 : a + 12].ljust(4, b"\0"))[0] for a in offsets], np.uint32)
    if len(bad := np.flatnonzero(masked(heads) != stored)):
        raise ValueError(f"bad length at {offsets[bad[0]]}")
    sizes = [struct.unpack("<Q", h)[0] for h in heads]
    payloads = [data[a + 12 : a + 12 + n] for a, n in zip(offsets, sizes)]
    if any(len(p) != n or len(data) < a + 16 + n for p, n, a in zip(payloads, sizes, offsets)):
        raise ValueError("a frame is cut off")
    stored = np.array([struct.unpack("<I", data[a + 12 + n : a + 16 + n])[0] for a, n in zip(offsets, sizes)], np.uint32)
    if len(bad := np.flatnonzero(masked(payloads) != stored)):
        raise ValueError(f"bad record at {offsets[bad[0]]}")
    return payloads


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    flags = (doc_id is not None) | wide << 1
    return struct.pack("<Bq", flags, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack("<Bq", payload[:9])
    return doc_id if flags & 1 else None, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9).astype("<u4")


# How the tokenizer file splits lower-cased text up to U+017F into words. İ is left out, as its small form is two characters.
_OTHER = r"[^\x{00}-\x{12f}\x{131}-\x{17f}]|<\|"
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼-¾"
_WORDS = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: printable ones as they are, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of whole texts by the tokenizers library, whose model gets each word once while it is remembered.

    For tokenizers that normalise, split and lower-case like the one used here (``_WORDS``). Texts are split into pieces at
    spaces and newlines; distinct pieces into words; ids of words are in one array. Pieces with characters beyond U+017F
    or special tokens go to the library whole. At most ``most`` words and those of one chunk of text are remembered.
    """

    def __init__(self, vocabulary: str, end_id: int = END_ID, most: int = WORDS, chunk: int = CHUNK):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.end, self.most, self.chunk = Tokenizer.from_file(vocabulary), end_id, most, chunk
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.known, self.starts, self.sizes, self.ids = {"\n": 0}, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def _forget(self, but: list[str] = []) -> None:  # noqa: B006
        """Empties the memory but for some of its words. Word 0 is a newline: the border of two pieces, without ids."""
        words = ["\n", *but]
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.ids, self.sizes = self.ids[_runs(self.starts[at], self.sizes[at])], self.sizes[at]
        self.starts, self.known = np.cumsum(self.sizes) - self.sizes, dict(zip(words, range(len(words))))

    def _add(self, words: list[str], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum()))
        self.known.update(zip(words, range(len(self.starts), len(self.starts) + len(words))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, flat])

    def _numbers(self, words: list[str], learn) -> np.ndarray:
        """Numbers of words in the memory, after ``learn`` has given the ids of those that aren't in it."""
        every = set(words)
        if new := list(every.difference(self.known)):
            if len(self.known) + len(new) > self.most:
                self._forget(list(every.intersection(self.known).difference("\n")))
            self._add(new, learn(new))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _by_model(self, words: list[str]) -> list[list[int]]:
        tokens, letters = self.model.tokenize, self.letters
        return [[t.id for t in tokens(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(letters))] for w in words]

    def _by_library(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct pieces: first id and number of ids of each, in the array that is returned last."""
        n = len(pieces)
        other = pc.match_substring_regex(pieces, _OTHER).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~other)
        starts, sizes, ids = np.zeros(n, np.int64), np.zeros(n, np.int64), [np.zeros(0, "<u4")]
        if len(plain):
            some = pieces.filter(pa.array(~other)) if other.any() else pieces
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), "\n")[0].as_py()
            words = self._numbers(_WORDS.findall(joined.lower()), self._by_model)
            k = self.sizes[words]
            own = np.concatenate([[0], np.cumsum(words == 0)])[:-1]  # the piece of each word
            sizes[plain] = np.bincount(own, k, len(plain)).astype(np.int64)
            starts[plain] = np.cumsum(sizes[plain]) - sizes[plain]
            ids.append(self.ids[_runs(self.starts[words], k)])
        if len(plain) < n:
            rest = np.flatnonzero(other)
            # remembered behind a newline, which no word begins with
            texts = pieces.take(pa.array(rest)).to_pylist()
            words = self._numbers(["\n" + t for t in texts], lambda new: self._by_library([w[1:] for w in new]))
            sizes[rest] = self.sizes[words]
            starts[rest] = len(ids[-1]) + np.cumsum(sizes[rest]) - sizes[rest]
            ids.append(self.ids[_runs(self.starts[words], sizes[rest])])
        return starts, sizes, np.concatenate(ids)

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids."""
        spaced = pc.replace_substring(pa.array(texts, pa.string()), "\n", " ")
        cut = pc.split_pattern(spaced, " ")
        pieces = cut.flatten().dictionary_encode()
        starts, sizes, ids = self._pieces(pieces.dictionary)
        at = pieces.indices.to_numpy()
        k = sizes[at]
        bounds = np.concatenate([[0], np.cumsum(k)])[cut.offsets.to_numpy()]
        return np.diff(bounds), ids[_runs(starts[at], k)]

    def _cut(self, text: str) -> list[str]:
        """A text in parts of about ``chunk`` characters, cut at spaces or newlines, which give no ids."""
        out, at = [], 0
        while len(text) - at > self.chunk:
            ends = [e for e in (text.find(" ", at + self.chunk), text.find("\n", at + self.chunk)) if e >= 0]
            if not ends:
                break
            out.append(text[at : min(ends)])
            at = min(ends) + 1
        return [*out, text[at:]]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, with the end id; a null text is an empty one."""
        group, size = [], 0
        for text in texts:
            for part in (parts := self._cut(text or "")):
                group.append((part, part is parts[-1]))
                size += len(part)
                if size >= self.chunk:
                    yield from self._group(group)
                    group, size = [], 0
        yield from self._group(group)

    _left: list[np.ndarray] = []  # of a text whose end is in a later group

    def _group(self, group: list[tuple[str, bool]]) -> Iterator[np.ndarray]:
        if not group:
            return
        sizes, ids = self._chunk([t for t, _ in group])
        end, at, left = np.array([self.end], "<u4"), 0, self._left
        for n, (_, last) in zip(sizes.tolist(), group):
            left = [*left, ids[at : at + n]]
            at += n
            if last:
                yield np.concatenate([*left, end])
                left = []
        self._left = left


def _writer(folder: str, vocabulary: str, end_id: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, at, offsets, tokens = TaskContext.get().partitionId(), None, 0, [], 0
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, own = f"{path}/tokens-{part:06d}.rec", f"{path}/.{uuid.uuid4().hex}"

        def put(payloads: list[bytes]) -> None:
            nonlocal at
            made = frames(payloads)
            out.write(b"".join(made))
            for f in made:
                offsets.append(at)
                at += len(f)

        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = kept("encoder", (vocabulary, end_id), lambda: Encoder(vocabulary, end_id))
            out, held, size = out or store.open_output_stream(own), [], 0
            texts = (x.as_py() for x in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts)):
                tokens += len(ids)
                held.append(pack(doc_id, ids))
                size += len(held[-1])
                if size > CHUNK // 4:
                    put(held)
                    held, size = [], 0
            put(held)
        if out:
            out.close()
            with store.open_output_stream(f"{own}.index") as f:
                f.write(np.array(offsets, "<u8").tobytes())
            # the names are the same for every attempt at this task, and so is what is in the files
            for a, b in ((f"{own}.index", f"{name}.index"), (own, name)):
                if store.get_file_info(b).type != fs.FileType.NotFound:  # left by a lost attempt
                    store.delete_file(b)
                store.move(a, b)
            held, batch = [], None
            release()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [os.path.basename(name)], "n_docs": [len(offsets)], "n_tokens": [tokens]})

    return of


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Writes ``docs(doc_id, text)`` in ascending doc_id order (null first, ties by the text's hash) to ``folder``.

    Returns the manifest, a written table with one row for each file: part, file, n_docs, n_tokens. A null text counts as an
    empty one. An empty table gives no file. Files hold about equal sums of text (see ``by_size``); rows of one doc_id are
    dealt over files by their texts' hashes, only rows alike in both stay together.
    """
    spark = docs.sparkSession
    key, tie = F.coalesce("doc_id", F.lit(-(2**63))), F.xxhash64("text")
    pid, n, _ = by_size(docs, key, F.octet_length("text"), tie)
    dealt = docs.select("doc_id", "text", pid(key, tie).alias("pid"), key.alias("key"), tie.alias("tie")).repartitionById(n, F.col("pid"))
    made = dealt.sortWithinPartitions("key", "tie").select("doc_id", "text").mapInArrow(_writer(folder, vocabulary, end_id), "part long, file string, n_docs long, n_tokens long")
    made.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _files(spark: SparkSession, folder: str) -> list[tuple[str, int, int, int]]:
    """File, first record, records and first id; one row for each file, so the driver holds it."""
    out, docs, ids = [], 0, 0
    for _, file, n, k in sorted(map(tuple, spark.read.parquet(f"{folder}/manifest").select("part", "file", "n_docs", "n_tokens").collect())):
        out.append((file, docs, n, ids))
        docs, ids = docs + n, ids + k
    return out


def _parts(store, file: str) -> Iterator[tuple[bytes, list[int]]]:
    """Runs of whole frames of a file, with their offsets in them; about READ bytes, or one frame."""
    with store.open_input_file(f"{file}.index") as f:
        offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
    with store.open_input_file(file) as f:
        bounds, i = np.append(offsets, f.size()), 0
        while i < len(offsets):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + READ, "right")) - 1)
            yield f.read_at(int(bounds[j] - bounds[i]), int(bounds[i])), (offsets[i:j] - offsets[i]).tolist()
            i = j


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of ``folder``: doc_id, start, n_tokens, ids_crc32; every checksum is verified.

    ``start`` counts the ids of all records before it. The manifest has one row for each file, so the driver holds it.
    """
    files = [(file, start) for file, _, _, start in _files(spark, folder)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns)):
                for data, offsets in _parts(store, f"{path}/{file}"):
                    got = [unpack(p) for p in unframe(data, offsets)]
                    sizes = np.fromiter((len(ids) for _, ids in got), np.int64, len(got))
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in got], pa.int64()), "start": start + np.cumsum(sizes) - sizes, "n_tokens": sizes, "ids_crc32": [zlib.crc32(ids) for _, ids in got]})
                    start += int(sizes.sum())

    return spark.createDataFrame(files, "file string, start long").repartition(min(len(files), READERS)).mapInArrow(of, schema)


def shuffled(spark: SparkSession, folder: str, seed: int = 0, parts: int | None = None) -> DataFrame:
    """All records of ``folder`` in a pseudorandom order: rows ``(place, doc_id, ids)``, places 0 to n - 1.

    A place's record is found by a keyed permutation and read through the index alone. ``parts`` tasks (by default one for
    each file) hold places one after the other; reruns agree.
    """
    from docspark.llm.mixing import permuted

    files = _files(spark, folder)
    schema = "place long, doc_id long, ids array<long>"
    if not files:
        return spark.createDataFrame([], schema)
    total, firsts, names = files[-1][1] + files[-1][2], np.array([f[1] for f in files]), [f[0] for f in files]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            places = batch.column(0).to_numpy()
            wanted = permuted(places, total, seed)
            own = np.searchsorted(firsts, wanted, "right") - 1
            for k in np.unique(own):
                at = np.flatnonzero(own == k)
                with store.open_input_file(f"{path}/{names[k]}.index") as index, store.open_input_file(f"{path}/{names[k]}") as data:
                    for i in at:
                        number = int(wanted[i] - firsts[k])
                        a, *b = np.frombuffer(index.read_at(16, 8 * number), "<u8").tolist()
                        doc_id, ids = unpack(unframe(data.read_at((b[0] if b else data.size()) - a, a), [0])[0])
                        yield pa.RecordBatch.from_pydict({"place": [int(places[i])], "doc_id": pa.array([doc_id], pa.int64()), "ids": pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))})

    return spark.range(0, total, 1, parts or min(len(files), READERS)).mapInArrow(of, schema)


def encoded(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """``docs`` written to a new folder beneath the shared one, and read back; see ``write`` and ``read``."""
    folder = new_path(docs.sparkSession, "tokens")
    write(docs, folder, vocabulary, end_id)
    return read(docs.sparkSession, folder)
