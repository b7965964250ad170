"""Fill-in-the-middle: texts are cut in three and put together in another order, from which they can be rebuilt.

The byte offsets at which code points begin (and the end of the text) are kept as a set of containers of 2^16 offsets, each
in its smallest form: an array of 16-bit offsets, a bitmap, or runs. With the numbers of offsets before each container,
the container of the k-th boundary is found by bisection and the boundary inside it by a select in its own form. Texts are cut
as UTF-8 bytes at the two boundaries, so nothing is decoded.

Defined results: a null text is empty and stays plain; texts of any length are cut whole; a null id is hashed as an empty
number; rows that repeat give the same output; an empty table gives no rows; columns besides the named ones are kept in
``_row``, whatever they are called. A text that holds one of the marks stays plain, so marks can be found again.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
PLAIN_FROM = 90  # of a hundred: from here on a text stays plain
SPM_BELOW = 20  # of a hundred: below, the suffix comes first
SPAN = 1 << 16


class Array:
    """Offsets in ascending order."""

    def __init__(self, offsets: np.ndarray):
        self.offsets = offsets.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.offsets[k])


class Bitmap:
    """A bit per offset, with the number of ones before each word."""

    def __init__(self, mask: np.ndarray):
        packed = np.zeros(SPAN // 8, np.uint8)
        bits = np.packbits(mask, bitorder="little")
        packed[: len(bits)] = bits
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        word, left = int(self.words[at]), k - int(self.before[at])
        for _ in range(left):
            word &= word - 1
        return at * 64 + (word & -word).bit_length() - 1


class Runs:
    """Starts of runs of neighbouring offsets, with the number of offsets before each."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts = starts
        self.before = np.cumsum(lengths) - lengths

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[at]) + k - int(self.before[at])


ARRAY_BYTES, BITMAP_BYTES, RUN_BYTES = 2, SPAN // 8, 4


def container(mask: np.ndarray) -> Array | Bitmap | Runs:
    """The offsets where ``mask`` is set, in the form that takes the fewest bytes."""
    edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    count = int((ends - starts).sum())
    if RUN_BYTES * len(starts) <= min(ARRAY_BYTES * count, BITMAP_BYTES):
        return Runs(starts, ends - starts)
    if ARRAY_BYTES * count <= BITMAP_BYTES:
        return Array(np.flatnonzero(mask))
    return Bitmap(mask)


class Boundaries:
    """The offsets in ``raw`` at which code points begin, and its end."""

    def __init__(self, raw: bytes):
        mask = np.empty(len(raw) + 1, bool)
        np.not_equal(np.frombuffer(raw, np.uint8) & 0xC0, 0x80, out=mask[:-1])
        mask[-1] = True
        self.before, self.containers = [0], []
        for at in range(0, len(mask), SPAN):
            part = mask[at : at + SPAN]
            self.containers.append(container(part))
            self.before.append(self.before[-1] + int(np.count_nonzero(part)))

    def __len__(self) -> int:
        return self.before[-1]

    def select(self, k: int) -> int:
        """Byte offset of the ``k``-th (from 0) boundary. Every container holds one: a code point has at most 4 bytes."""
        at = bisect_right(self.before, k) - 1
        return at * SPAN + self.containers[at].select(k - self.before[at])


def arranged(raw: bytes, h: tuple[int, int, int, int]) -> tuple[str, int | None, int | None, bytes, int]:
    """Form, code points of prefix and middle, output, and code points of the text."""
    cuts = Boundaries(raw)
    n = len(cuts) - 1
    if not n or h[2] % 100 >= PLAIN_FROM or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, raw, n
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    i, j = cuts.select(a), cuts.select(b)
    prefix, middle, suffix = raw[:i], raw[i:j], raw[j:]
    if h[3] % 100 < SPM_BELOW:
        return "spm", a, b - a, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), n
    return "psm", a, b - a, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), n


def rebuilt(output: bytes, form: str) -> bytes:
    """The text from its output. The parts hold no marks, so the first of each kind is the one that was put in."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


FIELDS = {"form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType(), "n": T.LongType()}


@F.arrow_udf(T.StructType([T.StructField(name, kind) for name, kind in FIELDS.items()]))
def _arranged(text: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
    numbers = zip(*(h.to_pylist() for h in (h1, h2, h3, h4)))
    rows = [arranged(raw.as_buffer().to_pybytes() if raw.is_valid else b"", h) for raw, h in zip(text.cast(pa.binary()), numbers)]
    form, prefix, middle, output, n = zip(*rows) if rows else ((),) * 5
    columns = [pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())]
    return pa.StructArray.from_arrays(columns, list(FIELDS))


@F.arrow_udf(T.StringType())
def restored(output: pa.Array, form: pa.Array) -> pa.Array:
    """Column function: the text again, from output and form."""
    return pa.array([rebuilt(o.as_buffer().to_pybytes(), f) for o, f in zip(output.cast(pa.binary()), form.to_pylist())], pa.binary()).cast(pa.string())


def numbers(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four 32-bit numbers of a document, the same in every run with this seed."""
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexes, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """All rows of ``docs`` as ``_row``, with ``_form, _prefix_chars, _middle_chars, _output`` and ``_n`` (code points)."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), _arranged(F.col(text), *numbers(F.col(doc_id), seed)).alias("_fim"))
    return rows.select("_row", *(F.col(f"_fim.{c}").alias(f"_{c}") for c in FIELDS))
