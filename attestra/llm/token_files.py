"""Token ids in compressed shard files that answer access, count and occurrence queries.

Documents are sorted by id over many tasks; every task cuts its part of the order into shards of about
``SHARD_TOKENS`` ids. A shard is one file entry: a header with the ids and lengths of its documents, and a wavelet
matrix over their tokens, that is one bit plane per bit of the ids, each compressed. Opening a shard unpacks its planes to
bits and counts the ones before each block; ``rank`` and ``select`` on the planes then read single tokens, count a token in a
range and find its occurrences without the sequence. The entries are written as a table in any folder Spark can reach, so a lost task is written again and committed once.

Defined results: a null or empty text has the end id alone; rows that share an id follow one another, by text; a
null id comes first; an empty table gives an empty file; one document may be longer than a shard and then is one by
itself; columns besides the named ones are not read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm.bpe import SHORT, VOCABULARY, normalised, spaced
from attestra.session import durable

SHARD_TOKENS = 4_000_000
KNOWN_CHUNKS = 400_000  # entries of the newer of two tables a worker keeps
TOGETHER = 256  # words that the library is given as one text
MARK = r"([A-Za-zÀ-ÖØ-öø-ɏ])([.,;:!?])(\s|$)"
PIECE_BYTES = 8_000_000  # of text that are encoded at once
END_ID = 1
MAGIC = b"WVM1"
FILE = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("blob", pa.binary())])
HEAD = struct.Struct("<4sBQQQ")  # magic, planes, documents, tokens, bytes of the document table
WORDS_PER_BLOCK = 8  # 64-bit words between two entries of a plane's rank directory


class Bits:
    """A plane of bits with counts of ones before every block of 512."""

    def __init__(self, packed: bytes, n: int):
        self.n = n
        words = np.zeros(-(-n // 512) * WORDS_PER_BLOCK + WORDS_PER_BLOCK, "<u8")
        words.view(np.uint8)[: len(packed)] = np.frombuffer(packed, np.uint8)
        self.words = words
        per_block = np.bitwise_count(words).reshape(-1, WORDS_PER_BLOCK).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(per_block)])

    def all(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    def __getitem__(self, i: int) -> int:
        return int(self.words[i >> 6]) >> (i & 63) & 1

    def rank(self, i: int) -> int:
        """Ones before position ``i``."""
        block, word = i >> 9, i >> 6
        ones = int(self.before[block]) + int(np.bitwise_count(self.words[block * WORDS_PER_BLOCK : word]).sum())
        return ones + (int(self.words[word]) & ((1 << (i & 63)) - 1)).bit_count()

    def select(self, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) bit of this kind."""
        counts = self.before if bit else np.arange(len(self.before), dtype=np.int64) * 512 - self.before
        block = int(np.searchsorted(counts, k, side="right")) - 1
        part = np.unpackbits(self.words[block * WORDS_PER_BLOCK : (block + 1) * WORDS_PER_BLOCK].view(np.uint8), bitorder="little")
        return block * 512 + int(np.flatnonzero(part == bit)[k - int(counts[block])])


class WaveletMatrix:
    def __init__(self, planes: list[bytes], n: int):
        self.n, self.planes = n, [Bits(p, n) for p in planes]
        self.zeros = [n - p.rank(n) for p in self.planes]

    @staticmethod
    def pack(ids: np.ndarray, bits: int) -> list[bytes]:
        """Planes from the highest bit on; each reorders the sequence, zeros first."""
        planes, now, kind = [], ids, ids.dtype.type
        spare, other = np.empty_like(ids), np.empty_like(ids)
        for b in reversed(range(bits)):
            ones = (now & kind(1 << b)) != 0
            planes.append(np.packbits(ones, bitorder="little").tobytes())
            if b:
                zeros = len(now) - int(np.count_nonzero(ones))
                np.compress(ones, now, out=spare[zeros:])
                np.compress(~ones, now, out=spare[:zeros])
                now, spare, other = spare, other, spare
        return planes

    def all(self) -> np.ndarray:
        """The whole sequence: the reordering undone plane by plane."""
        now = np.zeros(self.n, np.uint32 if len(self.planes) > 16 else np.uint16)
        for b, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            ones = plane.all()
            above = np.empty_like(now)
            above[~ones] = now[:zeros]
            above[ones] = now[zeros:] | now.dtype.type(1 << b)
            now = above
        return now

    def access(self, i: int) -> int:
        token = 0
        for plane, zeros in zip(self.planes, self.zeros):
            bit = plane[i]
            token = token << 1 | bit
            i = zeros + plane.rank(i) if bit else i - plane.rank(i)
        return token

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for b, plane, zeros in zip(reversed(range(len(self.planes))), self.planes, self.zeros):
            a, c = plane.rank(lo), plane.rank(hi)
            lo, hi = (zeros + a, zeros + c) if token >> b & 1 else (lo - a, hi - c)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``token`` among the positions from ``lo`` to before ``hi``."""
        if token >> len(self.planes):
            return 0
        lo, hi = self._range(token, lo, self.n if hi is None else hi)
        return hi - lo

    def occurrence(self, token: int, k: int) -> int | None:
        """Position of the ``k``-th (from 0) occurrence, or None."""
        if token >> len(self.planes):
            return None
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            return None
        i = lo + k
        for b, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            i = plane.select(1, i - zeros) if token >> b & 1 else plane.select(0, i)
        return i


class Shard:
    """One entry read back: document ids (None for a null id), lengths with the end id, and the matrix."""

    def __init__(self, blob: bytes):
        magic, planes, docs, n, size = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        sizes = struct.unpack_from(f"<{planes}Q", blob, HEAD.size)
        at = HEAD.size + 8 * planes
        unpack = zstandard.ZstdDecompressor().decompress
        table = unpack(blob[at : at + size])
        at += size
        known, ids, lengths = table[:docs], np.frombuffer(table, "<i8", docs, docs), np.frombuffer(table, "<u8", docs, 9 * docs)
        self.doc_ids = [i if k else None for i, k in zip(ids.tolist(), known)]
        self.lengths = lengths.tolist()
        data = []
        for s in sizes:
            data.append(unpack(blob[at : at + s]))
            at += s
        self.matrix = WaveletMatrix(data, n)


def shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    bits = max(int(ids.max()).bit_length(), 1) if len(ids) else 1
    narrow = ids.astype(np.uint16) if bits <= 16 else ids
    squeeze = zstandard.ZstdCompressor(level=1).compress
    planes = [squeeze(p) for p in WaveletMatrix.pack(narrow, bits)]
    table = squeeze(bytes(i is not None for i in doc_ids) + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array(lengths, "<u8").tobytes())
    head = HEAD.pack(MAGIC, bits, len(doc_ids), len(ids), len(table)) + struct.pack(f"<{bits}Q", *map(len, planes))
    return b"".join([head, table, *planes])


class Encoder:
    """The tokenizers library, asked for each chunk between white space once while a worker remembers it.

    What is remembered is held in two tables of bounded size: when the newer is full it becomes the older, and chunks
    that are met again move up.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use the cores
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            end = json.load(f)["model"]["end_of_word_suffix"]
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(end)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, list[int]]:
        """The ids of all texts after one another, and how many each has. White space separates words in the tokenizer's
        own rule, so a text's ids are those of its chunks; texts that may hold special tokens go whole. A letter and the
        mark after it are never one word, so a space between them changes no ids and leaves fewer distinct chunks.

        Arrow numbers the distinct chunks, so that each is looked up once a batch, and the ids are gathered by number.
        """
        apart = pc.replace_substring_regex(texts, MARK, r"\1 \2\3").to_pylist()
        cut = [[texts[i].as_py()] if t and "<|" in t else spaced(normalised(t)) if t else [] for i, t in enumerate(apart)]
        chunks = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
        ids = self._ids(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, number = np.frombuffer(b"".join(ids), "<u4"), chunks.indices.to_numpy()
        size = sizes[number]
        ends = np.cumsum(size)
        shift = np.repeat((np.cumsum(sizes) - sizes)[number] - (ends - size), size)
        shift += np.arange(len(shift))
        before = np.concatenate([[0], ends])[np.cumsum([0, *map(len, cut)])]
        return flat[shift], np.diff(before).tolist()

    def _ids(self, wanted: list[str]) -> list[bytes]:
        """Of distinct chunks."""
        out = list(map(self.known.get, wanted))
        gaps = [i for i, ids in enumerate(out) if ids is None]
        if gaps:
            new = self._asked([wanted[i] for i in gaps])
            for i in gaps:
                out[i] = new[wanted[i]]
            if len(self.known) >= KNOWN_CHUNKS:
                self.known, self.older = {}, self.known
            self.known.update(new)
            for c in new:
                if len(c) > SHORT:
                    del self.known[c]
        return out

    def _asked(self, chunks: list[str]) -> dict[str, bytes]:
        """Of distinct chunks that the newer table lacks."""
        new, words, rest, older = {}, [], [], self.older
        for c in chunks:
            if c in older:
                new[c] = older[c]
            elif c.isalpha() and len(c) <= SHORT:
                words.append(c)
            else:
                rest.append(c)
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for group, e in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group):  # one word each
                raw, at = ids.tobytes(), 0
                for c, to in zip(group, (4 * ends).tolist()):
                    new[c], at = raw[at:to], to
            else:
                rest += group
        for c, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False)):
            new[c] = array("I", e.ids).tobytes()
        return new


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of the pieces in which a batch is encoded: about ``PIECE_BYTES`` of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_BYTES)))
        yield at, to - at
        at = to


def write_tokens(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the shard files of ``docs`` in ascending order of ids to ``folder``: ``part, seq, n_docs, n_tokens, blob``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        names, lengths, held, n = [], [], [], 0

        def entry() -> pa.RecordBatch:
            row = {"part": part, "seq": seq, "n_docs": len(names), "n_tokens": n, "blob": shard(names, lengths, np.concatenate(held))}
            return pa.RecordBatch.from_pylist([row], FILE)

        for batch in batches:
            for at, count in pieces(batch.column(1)):
                some = batch.slice(at, count)
                ids, sizes = encoder(vocabulary).batch(some.column(1))
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id)  # after each document
                names += some.column(0).to_pylist()
                lengths += [size + 1 for size in sizes]
                held.append(ids)
                n += len(ids)
                if n >= shard_tokens:
                    yield entry()
                    names, lengths, held, n, seq = [], [], [], 0, seq + 1
        if names:
            yield entry()

    rows.mapInArrow(run, "part int, seq int, n_docs long, n_tokens long, blob binary").write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids`` (binary, little-endian unsigned 32-bit)."""
    return _located(spark, folder, "ids binary", lambda ids: ids.tobytes(), pa.binary())


def token_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """As :func:`read_tokens`, with the ids' crc32 in the place of the ids."""
    return _located(spark, folder, "ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes()), pa.int64())


def _located(spark: SparkSession, folder: str, column: str, value, kind: pa.DataType) -> DataFrame:
    files = spark.read.schema("part int, seq int, n_docs long, n_tokens long, blob binary").parquet(folder)
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                got = Shard(blob.as_py())
                ids, ends = got.matrix.all().astype("<u4"), np.cumsum(got.lengths)
                starts = ends - got.lengths
                values = [value(ids[a:b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got.doc_ids, pa.int64()), pa.array([part] * len(values), pa.int32()), pa.array([seq] * len(values), pa.int32()), pa.array(starts, pa.int64()), pa.array(got.lengths, pa.int64()), pa.array(values, kind)],
                    ["doc_id", "part", "seq", "at", "n_tokens", name],
                )

    rows = files.select("part", "seq", "blob").mapInArrow(run, f"doc_id long, part int, seq int, at long, n_tokens long, {column}")
    return rows.join(_offsets(files), ["part", "seq"]).select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", name)


def _offsets(files: DataFrame) -> DataFrame:
    """Tokens before each shard: within its part, plus those of all parts before (one row per task of the writer)."""
    sizes = durable(files.select("part", "seq", "n_tokens"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier.orderBy("part")), F.lit(0)).alias("p"))
    inner = F.coalesce(F.sum("n_tokens").over(earlier.partitionBy("part").orderBy("seq")), F.lit(0))
    return sizes.withColumn("s", inner).join(parts, "part").select("part", "seq", (F.col("s") + F.col("p")).alias("before"))
