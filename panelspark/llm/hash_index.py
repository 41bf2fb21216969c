"""Exact duplicates through an extendible-hash index in the shared folder.

The index has pages (distinct texts of a reading task, with the key of their
normalised text, on shared files) and a directory: the leading bits of a key
name a bucket. A bucket beyond ``bucket_bytes`` is split and, where its depth
passes the directory's, the directory doubles. Owner tasks take whole buckets,
which are ranges of keys, go through them in key order, chain the texts of one
key and compare bytes.
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
class IndexParams:
    """``key_bits`` below 64 force collisions in tests; ``max_depth`` bounds the directory at 2**max_depth entries."""
    bucket_bytes: int = 4 << 20
    max_depth: int = 18
    key_bits: int = 64


PAGE = "key long, sha string, text binary, n_bytes long, ids array<long>, top long"


def pages(docs: DataFrame, p: IndexParams) -> DataFrame:
    """The distinct normalised texts of every batch read, each with its doc_ids: copies met together travel once."""
    def run(batches):
        for batch in batches:
            for part in tb.slices(batch, "text", 1 << 23):
                data, off = tb.flat(part.column("text"))
                raw = tb.lowered(data).tobytes()
                held: dict[bytes, list] = {}
                for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    held.setdefault(raw[off[k]:off[k + 1]], []).append(doc_id)
                sha = [hashlib.sha256(t).digest() for t in held]
                keys = [int.from_bytes(s[:8], "big") >> (64 - p.key_bits) << (64 - p.key_bits) for s in sha]
                ids = [sorted(v, key=lambda x: (x is None, -(x or 0))) for v in held.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array([s.hex() for s in sha], pa.string()),
                     pa.array(list(held), pa.binary()), pa.array([len(t) for t in held], pa.int64()),
                     pa.array(ids, pa.list_(pa.int64())), pa.array([v[0] for v in ids], pa.int64())],
                    names=["key", "sha", "text", "n_bytes", "ids", "top"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PAGE)


def split_directory(sizes: dict[int, int], p: IndexParams) -> list[tuple[int, int]]:
    """(first prefix, local depth) per bucket, with prefixes of ``max_depth`` bits and their sizes given."""
    total = np.zeros((1 << p.max_depth) + 1, np.int64)
    for prefix, size in sizes.items():
        total[prefix + 1] = size
    total = np.cumsum(total)
    todo, out = [(0, 0)], []
    while todo:
        first, depth = todo.pop()
        width = 1 << (p.max_depth - depth)
        if depth < p.max_depth and total[first + width] - total[first] > p.bucket_bytes:
            todo += [(first + width // 2, depth + 1), (first, depth + 1)]
        else:
            out.append((first, depth))
    return sorted(out)


def exact_duplicates(docs: DataFrame, params: IndexParams = IndexParams()) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of (doc_id, text).

    Texts are equal when their bytes are after lower-casing A-Z; null is the
    empty text. The row with the largest doc_id of equal texts is kept, and of
    rows that repeat this doc_id one. A null doc_id is smaller than any other;
    where a group has no other, keep_id is null and one row is kept. Other
    columns are not looked at.
    """
    p = params
    spark = docs.sparkSession
    held = stage(pages(docs, p))
    prefix = F.expr(f"CAST(shiftrightunsigned(key, {64 - p.max_depth}) AS INT)")
    # at most 2**max_depth rows of two numbers, whatever the input
    sizes = {r[0]: r[1] for r in held.groupBy(prefix.alias("prefix")).agg(F.sum("n_bytes")).toLocalIterator()}
    buckets = split_directory(sizes, p)
    depth = max(d for _, d in buckets)
    directory = []
    for bucket, (first, local) in enumerate(buckets):
        at = first >> (p.max_depth - depth)
        directory += [(x, bucket) for x in range(at, at + (1 << (depth - local)))]
    directory = spark.createDataFrame(directory, "slot int, bucket int")
    slot = F.expr(f"CAST(shiftrightunsigned(key, {64 - depth}) AS INT)") if depth else F.lit(0)
    owned = held.withColumn("slot", slot).join(F.broadcast(directory), "slot").repartition("bucket")
    owned = owned.sortWithinPartitions("bucket", "key", F.desc_nulls_last("top")).select("key", "sha", "text", "ids", "top")

    def owner(batches):
        now, chain = None, []
        for batch in batches:
            out = []
            for key, sha, text, ids, top in zip(*(batch.column(c).to_pylist() for c in ("key", "sha", "text", "ids", "top"))):
                if key != now:
                    now, chain = key, []
                link = next((k for k, (seen, _) in enumerate(chain) if seen == text), None)
                fresh = link is None
                if fresh:
                    link = len(chain)
                    chain.append((text, top))
                out += [(key, link, x, chain[link][1], fresh and k == 0, sha) for k, x in enumerate(ids)]
            columns = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             names=["key", "link", "doc_id", "keep_id", "kept", "text_sha256"])

    found = stage(owned.mapInArrow(owner, "key long, link int, doc_id long, keep_id long, kept boolean, text_sha256 string"))
    groups = found.groupBy("key", "link").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(groups, ["key", "link"], "left").select(
        "doc_id", "keep_id", F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "kept", "text_sha256")
