"""Whole batches of text as flat numpy arrays: bytes, words, shingles and 64-bit hashes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. All separators and A-Z
are single bytes in UTF-8, so working on bytes gives the same words as working
on characters. Hashes are polynomials over a table of random 64-bit values per
byte, modulo 2**64, finished by a mixing step.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MUL = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def worker_cache() -> dict:
    """What one Python worker keeps between tasks: tables that depend on parameters only."""
    return sys.modules.setdefault("_panelspark_worker", types.ModuleType("_panelspark_worker")).__dict__


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MUL**i and INV**i for i up to n."""
    cache = worker_cache()
    have = cache.get("powers")
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 20)
        out = []
        for base in (MUL, INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        cache["powers"] = have = (out[0], out[1])
    return have


def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column in a row, and where each value starts; null is empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_null(arr.type):
        arr = arr.cast(pa.string())
    if not pa.types.is_binary(arr.type) and not pa.types.is_large_binary(arr.type):
        arr = arr.cast(pa.large_binary()) if pa.types.is_large_string(arr.type) else arr.cast(pa.binary())
    arr = pc.fill_null(arr.cast(pa.large_binary()), b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21):
    """The batch in runs of rows of about ``limit`` bytes of text; a longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def spare(columns: list[str], name: str) -> str:
    """A column name that none of ``columns`` has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(columns: list[str]) -> list[str]:
    """Names as Spark takes them literally, dots and all."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def give_back() -> None:
    """Hand memory that this worker no longer uses to the system: a worker lives on and serves other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def parts(batches, column: str, limit: int = 1 << 20):
    """The slices of all batches; what they leave behind is given back every 64 MB of text and at the end."""
    seen = 0
    try:
        for batch in batches:
            for part in slices(batch, column, limit):
                seen += part.nbytes
                yield part
                if seen > 1 << 26:
                    give_back()
                    seen = 0
    finally:
        give_back()


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for every text the number of words before it."""
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, word[:-1]
        after[-1], after[:-1] = False, word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        before[inner] = False
        after[inner - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = the polynomial of data[i:j], times MUL**i."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values()[data] * p[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per span [start, end)."""
    _, inv = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles, over A-Z lower-cased words.

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    data = lowered(data)
    starts, ends, first = word_bounds(data, offsets)
    words = span_hash(prefix_hash(data), starts, ends)
    coef = [np.uint64(pow(0xE7037ED1A0B428DB, k + 1, 1 << 64)) for k in range(width)]
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += words[k:k + n] * coef[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a:b - width + 1]))
        elif b > a:
            short = np.append(words[a:b] * np.array(coef[:b - a], np.uint64), mix(np.array([b - a], np.uint64)))
            out.append(mix(short.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
