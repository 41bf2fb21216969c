"""Fill-in-the-middle: a text is cut at two token boundaries and its parts change places.

Texts stay UTF-8 bytes. Every text is cut into blocks of a fixed number of bytes,
and a Fenwick tree over the blocks holds how many units (runs of letters, or
single other characters) and how many code points begin in each. Binary lifting
goes down the tree to the block that a cut falls into; inside it the boundary is
looked up. All texts of a batch go down together.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import textbytes as tb

MARKS = (b"<P>", b"<S>", b"<M>")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class FimParams:
    """Of 100 documents ``transformed`` are cut, and of 100 of these ``spm`` have the suffix first."""
    seed: str = "1:"
    transformed: int = 90
    spm: int = 20
    block: int = 512


class BlockTrees:
    """One Fenwick tree per text over its blocks, all in one array; node i of a text is at ``first[text] + i - 1``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, block: int):
        self.off, self.block = off, block
        point = (data & 0xC0) != 0x80
        letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
        after = np.zeros(len(data), bool)  # goes on with the letters before it
        after[1:] = letter[1:] & letter[:-1]
        begin = off[:-1][off[:-1] < len(data)]
        after[begin] = False
        self.point, self.unit = point, point & ~after
        sizes = np.diff(off)
        self.blocks = -(-sizes // block)
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])
        total = int(self.first[-1])
        text = np.repeat(np.arange(len(sizes)), self.blocks)
        self.node = np.arange(total) - self.first[text] + 1
        starts = off[text] + (self.node - 1) * block
        self.units, self.points = (np.add.reduceat(x.astype(np.int64), starts) if total else np.zeros(0, np.int64) for x in (self.unit, self.point))
        self.n = np.bincount(text, self.units, len(sizes)).astype(np.int64) if total else np.zeros(len(sizes), np.int64)
        # every node adds itself to the next one that covers it, from the lowest level up
        step, reach = 1, self.blocks[text]
        while step < (int(self.blocks.max()) if len(sizes) else 0):
            low = np.flatnonzero(((self.node & (2 * step - 1)) == step) & (self.node + step <= reach))
            self.units[low + step] += self.units[low]
            self.points[low + step] += self.points[low]
            step *= 2

    def cut(self, text: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and code point behind the first k units of each text named."""
        at, left, points = np.zeros(len(text), np.int64), k.astype(np.int64), np.zeros(len(text), np.int64)
        step = 1 << max(0, int(self.blocks.max()).bit_length() - 1) if len(self.blocks) else 0
        while step and len(self.units):
            nxt = at + step
            node = np.minimum(self.first[text] + nxt - 1, len(self.units) - 1)
            go = (nxt <= self.blocks[text]) & (self.units[node] <= left)
            at = np.where(go, nxt, at)
            left = np.where(go, left - self.units[node], left)
            points = np.where(go, points + self.points[node], points)
            step //= 2
        byte = np.minimum(self.off[text] + at * self.block, self.off[text + 1])
        for i in np.flatnonzero(at < self.blocks[text]):
            a, b = int(byte[i]), int(min(byte[i] + self.block, self.off[text[i] + 1]))
            byte[i] = a + np.flatnonzero(self.unit[a:b])[left[i]]
            points[i] += int(self.point[a:byte[i]].sum())
        return byte, points


def draws(doc_id, seed: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the hash of a doc_id; a null one counts as the word null."""
    digest = hashlib.sha256(f"{seed}{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * i:8 * i + 8], 16) for i in range(4))


def restore(output: bytes, form: str) -> bytes:
    """The text that an output was made from. A mark cannot begin inside another one, so the first find is the mark."""
    if form == "plain":
        return output
    p, s, m = MARKS
    head, tail = (p, s) if form == "psm" else (s, p)
    cut = output.index(tail, len(head))
    first = output[len(head):cut]
    end = output.index(m, cut + len(tail))
    second, middle = output[cut + len(tail):end], output[end + len(m):]
    return first + middle + second if form == "psm" else second + middle + first


def _transform(ids: list, data: np.ndarray, off: np.ndarray, p: FimParams) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) per text."""
    trees = BlockTrees(data, off, p.block)
    drawn = np.array([draws(i, p.seed) for i in ids], np.int64).reshape(-1, 4)
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(off[:-1], off[1:])]
    plain = (drawn[:, 2] % 100 >= p.transformed) | np.array([not t or any(m in t for m in MARKS) for t in texts], bool)
    ends = np.sort(drawn[:, :2] % (trees.n + 1)[:, None], axis=1)
    who = np.flatnonzero(~plain)
    first, first_points = trees.cut(who, ends[who, 0])
    second, second_points = trees.cut(who, ends[who, 1])
    out: list[tuple] = [(int(n), "plain", None, None, t) for n, t in zip(trees.n, texts)]
    for i, a, b, pa_, pb in zip(who.tolist(), first.tolist(), second.tolist(), first_points.tolist(), second_points.tolist()):
        prefix, middle, suffix = raw[off[i]:a], raw[a:b], raw[b:off[i + 1]]
        spm = drawn[i, 3] % 100 < p.spm
        output = b"".join((MARKS[1], suffix, MARKS[0], prefix, MARKS[2], middle) if spm else (MARKS[0], prefix, MARKS[1], suffix, MARKS[2], middle))
        out[i] = (int(trees.n[i]), "spm" if spm else "psm", pa_, pb - pa_, output)
    return out


def _mapped(docs: DataFrame, p: FimParams, schema: str, finish) -> DataFrame:
    def run(batches):
        for part in tb.parts(batches, "text"):
            ids = part.column("doc_id").to_pylist()
            rows = [finish(i, row) for i, row in zip(ids, _transform(ids, *tb.flat(part.column("text")), p))]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            types = [pa.int64() if t == "long" else pa.string() for _, t in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[n for n, _ in names])

    names = [c.split() for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, params: FimParams = FimParams()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row of (doc_id, text).

    n is the number of units; the two cuts, the form and the order of the parts
    follow from a hash of doc_id, so reruns agree. form is plain (the text as it
    is), psm or spm. A text that is empty or holds a mark is plain; null counts
    as the empty text; rows that repeat a doc_id are cut by the same numbers,
    each by its own length; a null doc_id draws as the word null. Other columns
    are not looked at. No rows, no rows.
    """
    return _mapped(docs, params, SCHEMA, lambda i, r: (i, *r[:4], r[4].decode("utf-8")))


def digests(docs: DataFrame, params: FimParams = FimParams()) -> DataFrame:
    """As ``fill_in_middle``, with hashes of the output and of the text rebuilt from it in place of the output."""
    def hashed(i, row):
        n, form, prefix, middle, output = row
        return i, n, form, prefix, middle, hashlib.sha256(output).hexdigest(), hashlib.sha256(restore(output, form)).hexdigest()

    return _mapped(docs, params, SCHEMA.replace("output string", "output_sha256 string, restored_sha256 string"), hashed)
