"""Packing documents into token sequences with the sum-of-squares rule.

A piece goes where the sum of the squared numbers of open bins per residual gap
becomes smallest. Bins of one gap are alike, so a choice is one pass over the
gaps, whatever the number of bins.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.stage import stage
from panelspark.llm import textbytes as tb
from panelspark.llm.encoding import Encoder


@dataclass(frozen=True)
class PackParams:
    """``group`` is the number of tokens that one packing task takes: large against ``length``, bounded in memory."""
    tokenizer: str = ""
    length: int = 2048
    end_id: int = 0
    group: int = 1 << 24


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first one takes the remainder."""
    first = n % length or length
    return [(0, min(n, first)), *((s, length) for s in range(first, n, length))] if n else []


def pieces(docs: DataFrame, p: PackParams) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of whole documents."""
    def run(batches):
        encoder = Encoder.held(p.tokenizer)
        for part in tb.parts(batches, "text"):
            out = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.ids(part.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(p.end_id)).astype("<u4")
                out += [(doc_id, k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), p.length))]
            cols = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item in the order given; every length is from 1 to ``capacity``.

    Moving a bin from gap g to gap h changes the sum by 2 * (n[h] - n[g] + 1);
    full and unopened bins do not count. Of equal choices the smallest gap left.
    """
    count = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bins = 0
    for i, size in enumerate(lengths.tolist()):
        gap = capacity
        if size < capacity:
            # from gap size + k to gap k; a bin that becomes full only leaves the sum
            old, new = count[size:capacity], count[:capacity - size]
            change = 2 * (new - old) + 2
            change[0] -= 1
            change[old == 0] = 1 << 60
            best = int(np.argmin(change)) if len(change) else 0
            if len(change) and change[best] <= 2 * count[capacity - size] + 1:
                gap = size + best
        if gap == capacity:
            bin_id, bins = bins, bins + 1
        else:
            bin_id = stacks[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = bin_id, capacity - gap
        if gap > size:
            stacks[gap - size].append(bin_id)
            count[gap - size] += 1
    return where, offset


def pack(pieced: DataFrame, params: PackParams) -> DataFrame:
    """The rows of ``pieced`` with sequence_id and offset; any rows with doc_id, piece and a length up to ``params.length``.

    Rows are dealt by hash to tasks of about ``group`` tokens, which pack them
    longest first; ties follow doc_id and piece. Rows of length 0 or null are
    dropped.
    """
    p = params
    total = pieced.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / p.group))

    def run(key, t):
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        where, offset = sum_of_squares(t.column("length").to_numpy(), p.length)
        return t.drop_columns(["_group"]).append_column("sequence_id", pa.array((key[0].as_py() << 32) + where)).append_column("offset", pa.array(offset))

    rows = pieced.where("length > 0").withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(groups)).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieced.schema.fields)
    return rows.groupBy("_group").applyInArrow(run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, params: PackParams) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece of the documents (doc_id, text).

    A document is its token ids and ``end_id``, so null and empty texts are one
    token. Documents beyond ``length`` are cut, the first piece taking the
    remainder. Rows that repeat a doc_id are documents of their own; a null
    doc_id stays null. Other columns are not looked at. No rows, no pieces.
    """
    return pack(stage(pieces(docs, params)), params)
