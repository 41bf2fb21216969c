"""Repeated byte strings through enhanced suffix arrays: maximal repeats of a length and all their occurrences.

Anchors (smallest gram hashes of a window) bring possible copies together: a
repeated string of the full length holds the same anchor at every occurrence.
Occurrences of an anchor with the same surroundings are one class; a class with
two places is a repeat as it stands. Where an anchor has several classes, their
surroundings become one enhanced suffix array, of which only the suffixes are
sorted whose preceding bytes differ among their equals; a scan with a stack
gives the tree of common-prefix intervals.
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


@dataclass(frozen=True)
class RepeatParams:
    """Strings of ``length`` bytes; anchors are grams of ``gram`` bytes, the smallest of each window of length - gram + 1.

    A task sorts the surroundings of at most ``block`` classes of one anchor;
    beyond that, strings of the full length meet by their hash instead.
    """
    length: int = 200
    gram: int = 100
    block: int = 16_000

    @property
    def window(self) -> int:
        return self.length - self.gram + 1


def anchors(data: np.ndarray, off: np.ndarray, p: RepeatParams):
    """(text, place, gram hash, context hash) of every window minimum of the texts, rightmost among equals.

    The context reaches from length - gram bytes before the gram to as many
    after it, cut at the ends of the text; it holds every string of ``length``
    bytes that contains the gram.
    """
    n = len(data)
    prefix = tb.prefix_hash(data)
    spans = np.diff(off)
    text = np.repeat(np.arange(len(spans)), spans)
    if n < p.length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    at = np.arange(n - p.gram + 1)
    gram = tb.span_hash(prefix, at, at + p.gram)
    key = (gram >> np.uint64(32) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
    low, width = key, 1
    while width * 2 <= p.window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:len(low) - (p.window - width)], low[p.window - width:]) if width < p.window else low
    whole = text[:len(low)] == text[p.length - 1:p.length - 1 + len(low)]
    place = (np.uint64(0xFFFFFFFF) - (low[whole] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    place = np.unique(place)
    owner = text[place]
    side = p.length - p.gram
    a, b = np.maximum(place - side, off[owner]), np.minimum(place + p.length, off[owner + 1])
    context = tb.span_hash(prefix, a, b) ^ tb.mix((place - a).astype(np.uint64))
    return owner, place - off[owner], gram[place].view(np.int64), context.view(np.int64)


def candidates(data: np.ndarray, base: np.ndarray, end: np.ndarray, lead: np.ndarray, length: int):
    """(text, start) of the strings of ``length`` bytes that start at base..base + lead and fit before end."""
    many = np.maximum(0, np.minimum(lead, end - base - length) + 1)
    text = np.repeat(np.arange(len(base)), many)
    start = base[text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return text, start


def suffix_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes data[start:end], and the common prefix of each with the one before it (0 for the first)."""
    longest = int((end - start).max()) if len(start) else 0
    padded = np.concatenate([data, np.zeros(longest, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, longest)[start] if longest else np.zeros((0, 0), np.uint8)
    rows[np.arange(longest) >= (end - start)[:, None]] = 0
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{longest}").reshape(-1), kind="stable") if longest else np.arange(len(start))
    rows, size = rows[order], (end - start)[order]
    common = np.zeros(len(start), np.int64)
    if len(start) > 1:
        differ = rows[1:] != rows[:-1]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), longest)
        common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
    return order, common


def intervals(common: np.ndarray, left: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of ``least`` or more whose preceding bytes are not all one.

    ``left`` has the byte before each suffix in sorted order; a negative value
    is a text's start and differs from every other.
    """
    out, stack = [], []  # open intervals: length, first, preceding byte if it is one
    mixed = -1_000_000_000

    def joined(a, b):
        return a if a == b and a >= 0 else mixed

    n = len(common)
    values = left.tolist()
    for i in range(1, n + 1):
        size = int(common[i]) if i < n else 0
        first, byte = i - 1, values[i - 1]
        while stack and stack[-1][0] > size:
            length, first, held = stack.pop()
            byte = joined(held, byte)
            if byte == mixed:
                out.append((length, first, i - 1))
        if size >= least:
            if stack and stack[-1][0] == size:
                stack[-1] = (size, stack[-1][1], joined(stack[-1][2], byte))
            else:
                stack.append((size, first, byte))
    return out


def repeat_tree(texts: list[bytes], length: int, lead=None, owner=None, shift=None):
    """(text, place, intervals): sorted suffixes and (length, first, last) over them, each a maximal repeat.

    A repeat is maximal if neither side can be prolonged at all its
    occurrences; the start and the end of a text stop it as well. With
    ``lead``, only those that start at place 0..lead of a text. Texts may be
    stretches of longer ones: ``owner`` and ``shift`` say of which and from
    where, and a place that several stretches show counts once, in the one that
    reaches furthest.
    """
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    base = end - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    text, start = candidates(data, base, end, size if lead is None else np.array(lead, np.int64), length)
    if owner is not None and len(start):
        place = start - base[text] + np.array(shift, np.int64)[text]
        # in the order of their ends, the last of each place stays
        by = np.lexsort((end[text] - start, place, np.array(owner, np.int64)[text]))
        own = np.array(owner, np.int64)[text][by]
        last = np.append((place[by][1:] != place[by][:-1]) | (own[1:] != own[:-1]), True)
        by = np.sort(by[last])
        text, start = text[by], start[by]
    if not len(start):
        return text, start, []
    _, at, times = np.unique(tb.span_hash(tb.prefix_hash(data), start, start + length), return_inverse=True, return_counts=True)
    left = np.where(start > base[text], data[start - 1].astype(np.int64), -1 - text)
    low, high = np.full(len(times), 1 << 40), np.full(len(times), -(1 << 40))
    np.minimum.at(low, at, left)
    np.maximum.at(high, at, left)
    keep = ((times > 1) & ((low != high) | (low < 0)))[at]
    text, start, left = text[keep], start[keep], left[keep]
    order, common = suffix_array(data, start, end[text])
    text = text[order]
    return text, start[order] - base[text], intervals(common, left[order], length)


def maximal_repeats(texts: list[bytes], length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, place), ...]) of the maximal repeats of ``length`` bytes or more, with all occurrences."""
    text, place, found = repeat_tree(texts, length)
    return [(n, list(zip(text[a:b + 1].tolist(), place[a:b + 1].tolist()))) for n, a, b in found]


def covered(texts: list[bytes], length: int, lead, owner, shift) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, from, to) that the maximal repeats cover: at each place the longest."""
    text, place, found = repeat_tree(texts, length, lead, owner, shift)
    reach = np.zeros(len(text), np.int64)
    for n, a, b in found:
        np.maximum(reach[a:b + 1], n, out=reach[a:b + 1])
    hit = reach > 0
    return text[hit], place[hit], (place + reach)[hit]


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _keyed(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.withColumn("th", F.xxhash64("text", F.octet_length("text")))


def _anchor_rows(keyed: DataFrame, p: RepeatParams) -> DataFrame:
    def run(batches):
        for batch in batches:
            # copies met together give their anchors once
            batch = batch.take(pa.array(np.sort(np.unique(batch.column("th").to_numpy(), return_index=True)[1])))
            th = batch.column("th").to_numpy()
            at = 0
            for part in tb.slices(batch, "text"):
                owner, place, gram, context = anchors(*tb.flat(part.column("text")), p)
                yield pa.RecordBatch.from_arrays([pa.array(th[at + owner]), pa.array(place.astype(np.int32)), pa.array(gram), pa.array(context)],
                                                 names=["th", "place", "g", "c"])
                at += len(part)

    return keyed.where(F.octet_length("text") >= p.length).select("th", "text").mapInArrow(run, "th long, place int, g long, c long")


def repeated_spans(keyed: DataFrame, params: RepeatParams) -> DataFrame:
    """(th, from, to): stretches of distinct texts that repeats cover; th names a text. They overlap; equal texts are one here."""
    p, side = params, params.length - params.gram
    many = _anchor_rows(keyed, p).groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    found = stage(_anchor_rows(keyed, p).join(many, "g", "left_semi"))
    spot = F.struct("th", "place")
    classes = found.groupBy("g", "c").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi"))
    classes = stage(classes.select("g", "c", "lo.th", "lo.place", (F.col("lo") != F.col("hi")).alias("multi")))
    alike = found.join(classes.where("multi").select("g", "c"), ["g", "c"])
    alike = alike.select("th", F.greatest(F.col("place") - side, F.lit(0)).alias("from"), (F.col("place") + p.length).alias("to"))

    groups = classes.groupBy("g").agg(F.count("*").alias("k"), F.count_if("multi").alias("m")).where("k > 1 AND m < k").select("g", "k")
    first = keyed.groupBy("th").agg(F.min("doc_id").alias("first"))
    open_ = classes.join(groups, "g").join(first, "th").withColumnRenamed("first", "doc_id")
    begin = F.greatest(F.col("place") - side, F.lit(0))
    context = F.substring(F.col("text").cast("binary"), begin + 1, F.col("place") + p.length - begin)
    around = stage(open_.join(keyed, (open_["th"] == keyed["th"]) & open_["doc_id"].eqNullSafe(keyed["doc_id"])).select(
        "g", "c", open_["th"], begin.alias("from"), (F.col("place") - begin).alias("lead"), "k", context.alias("context")))

    def solve(batches):
        held, last = [], None

        def answer(rows):
            rows = list({(g, c): r for g, c, *r in rows}.values())
            th, shift = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            text, a, b = covered([r[3] for r in rows], p.length, [r[2] for r in rows], th, shift)
            return pa.RecordBatch.from_arrays([pa.array(th[text]), *(pa.array((shift[text] + x).astype(np.int32)) for x in (a, b))],
                                              names=["th", "from", "to"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "c", "th", "from", "lead", "context"))):
                if row[0] != last and len(held) >= p.block // 4:
                    yield answer(held)
                    held = []
                last = row[0]
                held.append(row)
        yield answer(held)

    small = around.where(F.col("k") <= p.block).repartition("g").sortWithinPartitions("g")
    sorted_out = small.select("g", "c", "th", "from", "lead", "context").mapInArrow(solve, "th long, from int, to int")

    def strings(batches):
        for batch in batches:
            for part in tb.slices(batch, "context", 1 << 18):
                data, off = tb.flat(part.column("context"))
                text, start = candidates(data, off[:-1], off[1:], part.column("lead").to_numpy(), p.length)
                key = tb.span_hash(tb.prefix_hash(data), start, start + p.length).view(np.int64)
                place = part.column("from").to_numpy()[text] + (start - off[text])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part.column("th").to_numpy()[text]), pa.array(place.astype(np.int32))],
                                                 names=["key", "th", "from"])

    hot = around.where(F.col("k") > p.block).select("th", "from", "lead", "context").mapInArrow(strings, "key long, th long, from int")
    place = F.struct("th", "from")
    twice = hot.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("key")
    hot = hot.join(twice, "key", "left_semi").select("th", "from", (F.col("from") + p.length).alias("to"))
    copies = keyed.groupBy("th").agg(F.count("*").alias("n"), F.first(F.octet_length("text")).alias("to")).where(F.col("n") > 1).where(F.col("to") >= p.length)
    return alike.unionByName(sorted_out).unionByName(hot).unionByName(copies.select("th", F.lit(0).alias("from"), "to"))


def remove_repeats(docs: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, runs, kept) per row of (doc_id, text).

    A byte goes if a string of ``length`` bytes over it also starts at another
    place, in the same or another document; strings are those of the input.
    runs are the maximal removed runs as (from, to), kept the remaining bytes.
    Null counts as the empty text; shorter texts stay whole; repeated rows are
    documents of their own and repeat each other; a null doc_id stays null.
    Other columns are not looked at.
    """
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, params).groupBy("th").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    joined = keyed.join(spans, "th", "left").select("doc_id", "text", "spans")

    def cut(batches):
        for batch in batches:
            for part in tb.slices(batch, "text", 1 << 22):
                data, off = tb.flat(part.column("text"))
                raw, out = data.tobytes(), []
                for i, spans in enumerate(part.column("spans").to_pylist()):
                    text = raw[off[i]:off[i + 1]]
                    runs = [(a, min(b, len(text))) for a, b in merge([(s["from"], s["to"]) for s in spans or ()])]
                    kept, at = [], 0
                    for a, b in runs:
                        kept.append(text[at:a])
                        at = b
                    kept = b"".join([*kept, text[at:]])
                    out.append((len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(),
                                [{"from": a, "to": b} for a, b in runs], kept))
                run = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
                cols = list(zip(*out)) if out else [[]] * 6
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), run, pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "runs", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                  "runs array<struct<from:int,to:int>>, kept binary")


def repeat_groups(docs: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:
    """(group, length, doc_id, th, place): every maximal repeat of ``length`` bytes or more, a row per occurrence.

    group is a hash of the repeated string, length its full length in bytes,
    which no context cuts; place is a byte of the text that th names. Maximal
    is as in ``repeat_tree``; the copies of a text are occurrences each. Only
    places in ``repeated_spans`` are looked at, and of those with the same next
    ``length`` bytes only such as differ in the byte before. One task compares
    what follows all the places of one such string.
    """
    p, keyed = params, _keyed(docs)
    spans = repeated_spans(keyed, p).groupBy("th").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    texts = keyed.groupBy("th").agg(F.first("text").alias("text"), F.count("*").alias("copies"))

    def starts(batches):
        for batch in batches:
            for part in tb.slices(batch, "text", 1 << 20):
                data, off = tb.flat(part.column("text"))
                prefix = tb.prefix_hash(data)
                for th, copies, spans, a, b in zip(part.column("th").to_pylist(), part.column("copies").to_pylist(),
                                                   part.column("spans").to_pylist(), off[:-1], off[1:]):
                    runs = merge([(x["from"], min(x["to"], b - a)) for x in spans])
                    at = np.concatenate([a + np.arange(x, max(x, y - p.length + 1)) for x, y in runs]).astype(np.int64)
                    left = np.where(at > a, data[at - 1].astype(np.int32), -1)
                    key = tb.span_hash(prefix, at, at + p.length).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(np.full(len(at), th, np.int64)), pa.array((at - a).astype(np.int32)),
                         pa.array(left.astype(np.int32)), pa.array(np.full(len(at), copies, np.int64))], names=["key", "th", "place", "left", "copies"])

    found = stage(texts.join(spans, "th").select("th", "text", "copies", "spans").mapInArrow(
        starts, "key long, th long, place int, left int, copies long"))
    open_ = found.groupBy("key").agg(F.sum("copies").alias("n"), F.min("left").alias("a"), F.max("left").alias("b"))
    open_ = open_.where("n > 1 AND (a <> b OR a < 0)").select("key")
    places = found.join(open_, "key", "left_semi").join(texts.select("th", "text"), "th")
    places = places.select("key", "th", "place", "left", "copies", F.expr("substring(cast(text AS binary), place + 1)").alias("rest"))

    def solve(table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("rest", "th", "place", "left", "copies"))))
        # a second copy stands for all the others
        rows = [r for r in rows for _ in range(min(2, r[4]))]
        common = np.zeros(len(rows), np.int64)
        for i in range(1, len(rows)):
            a, b = rows[i - 1][0], rows[i][0]
            n = min(len(a), len(b))
            differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) if a[:n] != b[:n] else ()
            common[i] = differ[0] if len(differ) else n
        left = np.array([r[3] if r[3] >= 0 else -1 - i for i, r in enumerate(rows)], np.int64)
        out = []
        for n, a, b in intervals(common, left, p.length):
            group = int.from_bytes(hashlib.blake2b(rows[a][0][:n], digest_size=8).digest(), "little", signed=True)
            out += [(group, n, th, place) for th, place in sorted({r[1:3] for r in rows[a:b + 1]})]
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["group", "length", "th", "place"])

    groups = places.groupBy("key").applyInArrow(solve, "group long, length long, th long, place int")
    return groups.join(keyed.select("doc_id", "th"), "th").select("group", "length", "doc_id", "th", "place")
