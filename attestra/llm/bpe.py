"""Byte pair encoding of whole texts and back, equal to the public tokenizer file it is given.

A text is normalised (NFC, white space, lower case), cut at white space into chunks and these into words;
each word is merged with a contiguous rank array. Every Python worker keeps the chunks it has met in a table
of bounded size, so that frequent words are merged once per worker and rare ones cost one merge.

Defined results: a null or empty text has no tokens and decodes to the empty string; texts of any length are
encoded whole; rows that repeat give the same tokens; columns besides the named one are left alone.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
NEVER = 1 << 60
ROWS_AT_ONCE = 128
SHORT = 96  # parts; longer words are merged with a heap, which gives the same merges
KNOWN_CHUNKS = 120_000  # entries of the newer of two tables a worker keeps; when full, it becomes the older one


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 is itself, the rest follows from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.tokens = [""] * (max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in self.added.items():
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        # Rank and merged token in one number, so that the smallest is the merge to do.
        self.merges = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges[vocab[a], vocab[b]] = rank << 20 | vocab[a + b]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")")
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Tokens of one word: part boundaries and the ranks of neighbouring parts side by side."""
        parts = [self.inner[b] for b in word]
        parts[-1] = self.last[word[-1]]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        rank = self.merges.get
        ranks = [rank(pair, NEVER) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            parts[i] = best & 0xFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges from a heap: scanning a word of n parts for each merge would cost n²."""
        n, rank = len(parts), self.merges.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := rank(pair, NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i]
            if parts[i] < 0 or j >= n or rank((parts[i], parts[j]), NEVER) != r:
                continue
            parts[i], parts[j] = r & 0xFFFFF, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] < n and (x := rank((parts[a], parts[right[a]]), NEVER)) != NEVER:
                    heapq.heappush(heap, (x, a))
        return [p for p in parts if p >= 0]

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk without white space, four bytes each, little end first."""
        if len(chunk) > 1 and chunk[:-1].isalpha() and not chunk[-1].isalpha():  # a word and its comma or full stop
            return self.known(chunk[:-1]) + self.known(chunk[-1])
        words = (chunk,) if chunk.isalpha() else self.words.findall(chunk)
        got = b"".join([array("I", self.merge(w.encode("utf-8", "surrogatepass"))).tobytes() for w in words])
        if len(self.chunks) >= KNOWN_CHUNKS:
            self.older, self.chunks = self.chunks, {}
        if len(chunk) <= SHORT:
            self.chunks[chunk] = got
        return got

    def known(self, chunk: str) -> bytes:
        got = self.chunks.get(chunk)
        if got is None:
            got = self.older.get(chunk)
            if got is None:
                return self.chunk(chunk)
            self.chunks[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            pieces = self.special.split(text)
            return b"".join(np.array([self.added[p]], "<u4").tobytes() if p in self.added else self._plain(p) for p in pieces)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        find = self.chunks.get
        return b"".join([find(c) or self.known(c) for c in spaced(normalised(text))])

    def decode(self, ids: bytes) -> str:
        """Without a decoder in the file, tokens are joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def normalised(text: str) -> str:
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # the rule is letter by letter; lower() would look at what follows
        return "".join(map(str.lower, text))
    return text.lower()


def spaced(text: str) -> list[str]:
    """Cut at Unicode white space; split() alone would also cut at four control characters."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [c for c in regex.split(r"\p{White_Space}+", text) if c]
    return text.split()


@lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    """One per worker and vocabulary."""
    return Bpe(path)


def encoded(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep``, then ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens`` and ``decoded`` (text of those ids).

    A batch of rows is taken a few at a time, so that a task holds the tokens of few texts besides its input.
    """
    rows = docs.select(*keep, F.col(text).alias("_text"))
    made = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids = [b.encode(t) if t else b"" for t in part.column(part.num_columns - 1).to_pylist()]
                new = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([b.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], [*part.schema.names[:-1], "ids", "n_tokens", "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *made]))
