"""Repeated windows of words: Rabin-Karp hashes of every window, counted in Spark, merged into removal intervals.

A window's hash comes from running sums over its words' hashes. Windows travel
together that have their smallest gram at one place: the hash of that gram says
which task counts them, and equal windows have equal smallest grams, so all
windows of one word sequence meet. A row of a task is a run of neighbouring
windows, so a window costs a few bytes and not a row. What a slice of documents
repeats as a whole run is settled before the shuffle, so that a frequent passage
sends one run per slice.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.stage import stage
from panelspark.llm import textbytes as tb

BLOCK = "bucket int, spread int, n int, key binary, doc binary, mark binary, start binary, rel binary, count binary, hashes binary"
HELD = 6  # bytes of a window's hash that travel, beside the eight of its gram


@dataclass(frozen=True)
class WindowParams:
    """Windows of ``words`` words; ``gram`` words make the gram that sorts them.

    ``bucket`` is the number of bytes of text that one counting task serves.
    """
    words: int = 20
    gram: int = 5
    slice: int = 1 << 21
    bucket: int = 1 << 24


def span_sums(words: np.ndarray) -> np.ndarray:
    """S with (S[j] - S[i]) / MUL**i = the polynomial of words[i:j]."""
    p, _ = tb.powers(len(words))
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p[:len(words)], out=out[1:])
    return out


def runs_of_windows(data: np.ndarray, off: np.ndarray, p: WindowParams):
    """Runs of neighbouring windows with one smallest gram: (text, first window, gram's place in it, count, gram hash, content hash), and all window hashes."""
    starts, ends, first = tb.word_bounds(data, off)
    words = tb.span_hash(tb.prefix_hash(data), starts, ends)
    sums, (_, inv) = span_sums(words), tb.powers(len(words) + 1)
    n = len(words) - p.words + 1
    if n <= 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, zero, zero, zero.view(np.uint64), zero.view(np.uint64), zero.view(np.uint64)
    grams = tb.mix((sums[p.gram:] - sums[:-p.gram]) * inv[:len(words) - p.gram + 1])
    windows = tb.mix((sums[p.words:] - sums[:-p.words]) * inv[:n])
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    whole = text[:n] == text[p.words - 1:]
    width = p.words - p.gram + 1
    rel = np.empty(n, np.int64)
    for a in range(0, n, 1 << 16):  # the leftmost smallest gram of each window
        b = min(n, a + (1 << 16))
        rel[a:b] = np.lib.stride_tricks.sliding_window_view(grams[a:b + width - 1], width).argmin(axis=1)
    at = np.flatnonzero(whole)
    place = at + rel[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    s = at[begin]
    content = tb.mix((sums[s + count + p.words - 1] - sums[s]) * inv[s] + count.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return text[s], s - first[text[s]], rel[s], count, grams[place[begin]], content, windows[at]


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as their least value and the differences from it, in as few bytes as the largest needs."""
    if not len(values):
        return b""
    low = int(values.min())
    rest = (values - low).astype(np.uint64)
    width = max(1, (int(rest.max()).bit_length() + 7) // 8)
    return low.to_bytes(8, "little", signed=True) + bytes([width]) + rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    out = np.zeros(((len(raw) - 9) // raw[8], 8), np.uint8)
    out[:, :raw[8]] = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, raw[8])
    return out.view("<u8").reshape(-1).astype(np.int64) + int.from_bytes(raw[:8], "little", signed=True)


def _spread(count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for count[i] steps, one after another."""
    if not len(count):
        return np.zeros(0, np.int64)
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _later(doc, mark, start, rel, count, key, hashes) -> np.ndarray:
    """For every window of the runs whether an equal one stands earlier, in the order of document, mark and place."""
    order = np.lexsort((start + rel, mark, doc))
    same = np.zeros(len(order), bool)
    same[1:] = (doc[order][1:] == doc[order][:-1]) & (mark[order][1:] == mark[order][:-1]) & ((start + rel)[order][1:] == (start + rel)[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(~same)  # rows that repeat a document are one place
    row = np.repeat(np.arange(len(count)), count)
    offset = _spread(count, np.zeros(len(count), np.int64))
    name = tb.mix(key[row] + tb.mix(hashes + ((rel[row] - offset).astype(np.uint64) << np.uint64(56))))
    by = np.argsort(name, kind="stable")
    head = np.ones(len(by), bool)
    head[1:] = name[by][1:] != name[by][:-1]
    least = np.minimum.reduceat(rank[row][by], np.flatnonzero(head)) if len(by) else rank[:0]
    out = np.empty(len(by), bool)
    out[by] = rank[row][by] > least[np.cumsum(head) - 1]
    return out


def _blocks(bucket, doc, mark, start, rel, count, key, hashes, spread) -> pa.RecordBatch:
    """One row per bucket with all its runs."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    first = np.cumsum(count) - count
    rows = []
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        pick = order[a:b]
        taken = hashes[_spread(count[pick], first[pick])] if key is not None else np.zeros(0, np.uint64)
        rows.append((int(bucket[pick[0]]), spread, len(pick), b"" if key is None else key[pick].astype("<u8").tobytes(), packed(doc[pick]), packed(mark[pick]),
                     packed(start[pick]), packed(rel[pick]), packed(count[pick]), taken.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HELD].tobytes()))
    columns = list(zip(*rows)) if rows else [[]] * 10
    names = [c.split()[0] for c in BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i < 3 else pa.binary()) for i, c in enumerate(columns)], names=names)


NO_ID = (1 << 63) - 1  # a null doc_id comes last


def _own(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, mark, text): mark tells texts of one doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.shiftrightunsigned(F.xxhash64(text), 32).alias("mark"), text.alias("text"))


def later_windows(docs: DataFrame, params: WindowParams = WindowParams()) -> DataFrame:
    """(doc, mark, from, to): runs of words under windows that stand earlier too; doc and mark as in ``_own``."""
    p, own = params, _own(docs)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // p.bucket))

    def windows(batches):
        for part in tb.parts(batches, "text", p.slice):
            text, start, rel, count, key, content, hashes = runs_of_windows(*tb.flat(part.column("text")), p)
            doc, mark = (part.column(c).to_numpy(zero_copy_only=False)[text].astype(np.int64) for c in ("doc", "mark"))
            # runs that the slice repeats as a whole: only the first is counted
            order = np.lexsort((start, mark, doc, content, key))
            copy = np.zeros(len(order), bool)
            copy[1:] = (key[order][1:] == key[order][:-1]) & (content[order][1:] == content[order][:-1]) & (rel[order][1:] == rel[order][:-1])
            head = order[np.maximum.accumulate(np.where(copy, 0, np.arange(len(order))))] if len(order) else order
            place = (doc[order] == doc[head]) & (mark[order] == mark[head]) & (start[order] == start[head])
            settled = np.zeros(len(order), bool)
            settled[order] = copy & ~place
            spread = int(start.sum() & 0x7FFF) if len(start) else 0
            send = np.flatnonzero(~settled)
            first = np.cumsum(count) - count
            yield _blocks((key[send] % np.uint64(buckets)).astype(np.int64), doc[send], mark[send], start[send], rel[send], count[send], key[send],
                          hashes[_spread(count[send], first[send])], 0)
            known = np.flatnonzero(settled)
            yield _blocks(np.full(len(known), spread % buckets), doc[known], mark[known], start[known], rel[known], count[known], None, hashes, 1)

    def judge(key, table):
        runs, known = [], []
        for settled, n, *columns in zip(*(table.column(c).to_pylist() for c in ("spread", "n", "key", "doc", "mark", "start", "rel", "count", "hashes"))):
            doc, mark, start, rel, count = (unpacked(c) for c in columns[1:6])
            if settled:
                known.append((doc, mark, start, start + count + p.words - 1))
                continue
            wide = np.zeros((int(count.sum()), 8), np.uint8)
            wide[:, :HELD] = np.frombuffer(columns[6], np.uint8).reshape(-1, HELD)
            runs.append((doc, mark, start, rel, count, np.frombuffer(columns[0], "<u8"), wide.view("<u8").reshape(-1)))
        if runs:
            doc, mark, start, rel, count, key, hashes = (np.concatenate(c) for c in zip(*runs))
            codes, inverse, often = np.unique(key, return_inverse=True, return_counts=True)
            again = np.flatnonzero(often[inverse] > 1)  # the others hold a gram of their own, so windows of their own
            first = (np.cumsum(count) - count)[again]
            hashes = hashes[_spread(count[again], first)]
            doc, mark, start, rel, count, key = (x[again] for x in (doc, mark, start, rel, count, key))
            gone = _later(doc, mark, start, rel, count, key, hashes)
            row = np.repeat(np.arange(len(count)), count)[gone]
            at = _spread(count, start)[gone]
            new = np.ones(len(at), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(at)) - 1
            known.append((doc[row[a]], mark[row[a]], at[a], at[b] + p.words) if len(a) else (doc[:0],) * 4)
        found = [np.concatenate(c) for c in zip(*known)] if known else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(found[0]), pa.array(found[1]), pa.array(found[2].astype(np.int32)), pa.array(found[3].astype(np.int32))],
                        names=["doc", "mark", "from", "to"])

    blocks = own.where("text IS NOT NULL").select("doc", "mark", "text").mapInArrow(windows, BLOCK)
    return blocks.groupBy("bucket").applyInArrow(judge, "doc long, mark long, from int, to int")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def drop_repeated_windows(docs: DataFrame, params: WindowParams = WindowParams()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, kept) per row of (doc_id, text).

    A word goes if a window of ``words`` words over it also starts earlier: in a
    smaller doc_id, or before it in the same document; windows are those of the
    input. spans are the maximal removed runs of words as (from, to), kept the
    other words, joined by one space. Null counts as the empty text; texts
    with fewer words stay whole; a null doc_id comes last; two texts of one
    doc_id are documents of their own, in the order of a hash; rows equal in
    doc_id and text are one document and get the same answer. Other columns are
    not looked at. No rows, no rows.
    """
    found = stage(later_windows(docs, params)).groupBy("doc", "mark").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    joined = _own(docs).join(found, ["doc", "mark"], "left").select("doc_id", "text", "spans")

    def cut(batches):
        for part in tb.parts(batches, "text"):
            rows = []
            for doc_id, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                words = (text or "").encode().split()  # bytes split at 0x20 and 0x09-0x0D
                runs = merged([(s["from"], s["to"]) for s in spans or ()])
                kept, at = [], 0
                for a, b in runs:
                    kept += words[at:a]
                    at = b
                kept = b" ".join(kept + words[at:])
                rows.append((doc_id, len(words), sum(b - a for a, b in runs), hashlib.sha256(kept).hexdigest(),
                             [{"from": a, "to": b} for a, b in runs], kept.decode()))
            columns = list(zip(*rows)) if rows else [[]] * 6
            span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<from:int,to:int>>, kept string")
