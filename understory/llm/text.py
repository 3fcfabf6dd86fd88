"""Shared helpers: Arrow text columns as byte arrays, words, and 64-bit hashes, all in numpy."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in runs of rows of about this many bytes; one longer text is a run of its own.
RUN_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def ready(spark: SparkSession) -> None:
    """Let Python workers that share the driver's file system import this package."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))) if x)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names; all others, clashing or not, are left out."""
    return df.select(*[quoted(src).alias(dst) for dst, src in columns.items()])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_runs(column: pa.Array | pa.ChunkedArray, max_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """Runs of consecutive rows (start, end, texts without NULLs), each of bounded size."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    n = len(column)
    sizes = np.asarray(pc.binary_length(column), np.int64)
    total, start = np.concatenate([[0], np.cumsum(sizes)]), 0
    while start < n:
        end = int(np.searchsorted(total, total[start] + max_bytes, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end, column.slice(start, end - start)
        start = end
    give_back()


def give_back() -> None:
    """Workers live on between tasks: what Arrow and the C library have freed goes back, so that it doesn't add up over stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


_KEPT: dict[str, dict] = {}


def kept(work: str) -> dict:
    """What this worker keeps from task to task for one kind of work; what it kept for another is dropped."""
    if work not in _KEPT:
        _KEPT.clear()
        gc.collect()  # an encoder and its stores hold each other
        give_back()
        _KEPT[work] = {}
    return _KEPT[work]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and the offsets of each (one more than there are texts)."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, off, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def byte_table(accepts) -> np.ndarray:
    """Which of the 256 byte values belong to a word."""
    return np.array([bool(accepts(b)) for b in range(256)])


LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of each text's first word (one more than there are texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = inside[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins = mask.copy()
    begins[1:] &= ~mask[:-1] | first[1:]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:] | first[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


with np.errstate(over="ignore"):
    _BYTE = mixed((np.arange(256, dtype=np.uint64) + _U(1)) * _BASE)
    _INVERSE = _U(pow(int(_BASE), -1, 1 << 64))

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept by the worker."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, RUN_BYTES + 1)
        for key, b in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, b, np.uint64)
            table[0] = 1
            with np.errstate(over="ignore"):
                np.cumprod(table, out=table)
            if size > RUN_BYTES + 1:  # a single very long text: don't keep what only it needs
                _POWERS[key + "_long"] = table
            else:
                _POWERS[key] = table
        if size > RUN_BYTES + 1:
            return _POWERS.pop("up_long"), _POWERS.pop("down_long")
    return _POWERS["up"], _POWERS["down"]


class SpanHasher:
    """64-bit hashes of any spans of one byte array by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        codes = _BYTE[LOWER] if lower else _BYTE
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        terms = self.sums[1:]
        np.multiply(codes[data], up[:len(data)], out=terms)
        np.cumsum(terms, out=terms)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def every(self, size: int, first: int, last: int) -> np.ndarray:
        """Hashes of the spans of one size that start at first, first + 1, ... before last."""
        return mixed((self.sums[first + size:last + size] - self.sums[first:last]) * self.down[first:last] + _U(size))


def run_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (len(words) - k + 1 of them), from the words' hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _U(0xD6E8FEB86659FD93) + words[j:j + n]
    return mixed(out + _U(k))


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values (len(x) - w + 1 of them), by doubling."""
    size, have = 1, x
    while size * 2 <= w:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    rest = w - size
    return np.minimum(have[:len(have) - rest], have[rest:]) if rest else have
