"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, grouping.

SuperMinHash draws, for every element, a random permutation of the slots and a
random rank that grows along the permutation. Level j of all elements is handled
at once; when every slot of a document holds a value of level j or lower, later
levels cannot change it and the document is done (early stopping).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.stage import stage
from panelspark.llm import textbytes as tb
from panelspark.llm.components import components


@dataclass(frozen=True)
class NearDupParams:
    """Threshold as a fraction, shingle width, and the shape of the signature.

    With 28 bands of 6 slots a pair at similarity 0.85 shares no band with a
    probability of about 2e-6, a pair at 0.8 with 2e-4 (use 34 bands of 5 there).
    ``block`` bounds the shingles that one comparing task holds.
    """
    percent: int = 85
    width: int = 5
    rows: int = 6
    bands: int = 28
    block: int = 2_000_000


def signatures(sets: list[np.ndarray], m: int, block: int = 1 << 17) -> np.ndarray:
    """One row of m slots per set, each the smallest (level, rank) that an element puts there.

    Elements are handled in blocks, so that memory is bounded for a set of any size.
    """
    n = np.array([len(s) for s in sets], np.int64)
    top = np.uint64(np.iinfo(np.uint64).max)
    h = np.full((len(sets), m), top, np.uint64)
    if not n.sum():
        return h
    elements, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    for at in range(0, len(elements), block):
        _draw(h, elements[at:at + block], owners[at:at + block])
    return h


def _draw(h: np.ndarray, element: np.ndarray, owner: np.ndarray) -> None:
    """Lower the slots of ``h`` by the ranks of a block of elements, level by level."""
    m, perm = h.shape[1], None
    for level in range(m):
        x = tb.mix(element + np.uint64(((level + 1) * 0x9E3779B97F4A7C15) & tb.M64))
        pick = level + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - level) >> np.uint64(32)).astype(np.int64)
        rank = (x >> np.uint64(32)) | np.uint64(level << 32)
        if level == 0:
            slot = pick
        else:
            each = np.arange(len(element))
            slot = perm[each, pick].astype(np.int64)
            perm[each, pick] = perm[:, level]
        np.minimum.at(h.reshape(-1), owner * m + slot, rank)
        lo = owner[0]
        open_docs = (h[lo:owner[-1] + 1] >> np.uint64(32)).max(axis=1) > level
        keep = open_docs[owner - lo]
        if level == 0:
            element, owner, first = element[keep], owner[keep], pick[keep]
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(element), 1))
            perm[np.arange(len(element)), first] = 0
        elif not keep.all():
            element, owner, perm = element[keep], owner[keep], perm[keep]
        if not len(element):
            break


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name for each set; equal sets have equal names."""
    sums = np.array([tb.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    return tb.mix(sums + np.array([len(s) for s in sets], np.uint64)).view(np.int64)


def link_sets(names, sets, roots, movers, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest: sets of a block meet by intersection size, one mover after another.

    ``roots`` are known component names; only sets of different components are
    compared, and only where at least one of the two is a mover.
    """
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    n = np.array([len(s) for s in sets], np.int64)
    codes, at = np.unique(np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(len(codes), bool)
    group = np.array([find(r) for r in roots], object)
    done = np.zeros(len(sets), bool)
    out = []
    for i in np.flatnonzero(np.asarray(movers, bool) & (n > 0)):
        done[i] = True
        mine = find(roots[i])
        near = ~done & (n * 100 >= n[i] * percent) & (n[i] * 100 >= n * percent) & (group != mine)
        near = np.array([j for j in np.flatnonzero(near) if find(roots[j]) != mine], np.int64)
        if not len(near):
            continue
        own = at[start[i]:start[i + 1]]
        mark[own] = True
        take = np.repeat(start[near], n[near]) + (np.arange(n[near].sum()) - np.repeat(np.cumsum(n[near]) - n[near], n[near]))
        both = np.add.reduceat(mark[at[take]].astype(np.int64), np.cumsum(n[near]) - n[near])
        mark[own] = False
        for j in near[both * 100 >= (n[near] + n[i] - both) * percent]:
            a, b = find(roots[i]), find(roots[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(names[i]), int(names[j])))
    return out


def describe(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """(doc_id, n_shingles, node, bands, text_hash) per document, from whole texts; node names the shingle set."""
    def run(batches):
        coef = tb.mix(np.arange(1, p.rows + 1, dtype=np.uint64)) | np.uint64(1)
        for part in tb.parts(batches, "text", 1 << 20):
            sets = tb.shingles(*tb.flat(part.column("text")), p.width)
            sig = signatures(sets, p.rows * p.bands).reshape(len(sets), p.bands, p.rows)
            keys = tb.mix((sig * coef).sum(axis=2, dtype=np.uint64) + np.arange(p.bands, dtype=np.uint64)).view(np.int64)
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * p.bands)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_keys(sets)),
                 pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1))), part.column("text_hash")],
                names=["doc_id", "n_shingles", "node", "bands", "text_hash"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(
        run, "doc_id long, n_shingles long, node long, bands array<long>, text_hash long")


def _compare(rows: DataFrame, p: NearDupParams) -> DataFrame:
    """Links (a, b) inside each (cluster, block, against); rows carry node, root, mover and the text."""
    def run(key, table):
        seen, names, sets, roots, movers = set(), [], [], [], []
        for piece in (piece for batch in table.to_batches() for piece in tb.slices(batch, "text")):
            found = tb.shingles(*tb.flat(piece.column("text")), p.width)
            made = set_keys(found)
            for k, (node, root, mover) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("node", "root", "mover")))):
                if made[k] == node and node not in seen:  # a repeated doc_id may bring another text
                    seen.add(node)
                    names.append(node)
                    sets.append(found[k])
                    roots.append(root)
                    movers.append(mover)
        links = link_sets(names, sets, roots, movers, p.percent)
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    rows = rows.select("cluster", "block", "against", "node", "root", "mover", "text")
    return rows.groupBy("cluster", "block", "against").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) per row of (doc_id, text).

    Documents are linked when 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest doc_id that links reach. Equal
    sets are one node. Nodes that share a band form clusters, and inside a
    cluster all pairs of different components are compared on full sets. A
    cluster beyond ``block`` shingles is cut: every block also gets the
    cluster's first node, so that its copies fall together, and what is still
    outside that component then meets every block.

    Null or empty texts and texts without words have 0 shingles and are linked
    with nothing. Rows of one doc_id keep one answer each; a null doc_id is kept
    with a null component. Other columns are not looked at.
    """
    p = params
    base = stage(describe(docs, p))
    ids = base.groupBy("node", "n_shingles").agg(F.min("doc_id").alias("rep"))
    full = base.where("n_shingles > 0")
    keys = full.groupBy("node").agg(F.first("bands").alias("bands"))
    entries = keys.select("node", F.posexplode("bands").alias("band", "key"))
    centers = entries.groupBy("band", "key").agg(F.min("node").alias("center"), F.count("*").alias("n")).where("n > 1")
    stars = stage(entries.join(centers, ["band", "key"]).where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct())
    cluster = components(stars).withColumnRenamed("component", "cluster")
    member = cluster.join(ids.where("n_shingles > 0"), "node")
    size = member.groupBy("cluster").agg(F.sum("n_shingles").alias("total"))
    member = member.join(size, "cluster").withColumn("blocks", F.ceil(F.col("total") / p.block).cast("int"))
    member = stage(member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))

    # every block also holds the first node of its cluster
    shared = member.where("blocks > 1 AND node = cluster").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = member.where("blocks = 1 OR node <> cluster").unionByName(shared)
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))

    def links(rows):
        return _compare(rows.join(texts.hint("merge"), "rep"), p)  # one plan at every size

    first = stage(links(rows.withColumns({"against": F.lit(-1), "root": F.col("node"), "mover": F.lit(True)})))
    large = member.where("blocks > 1")
    if large.limit(1).count():
        known = components(first.union(large.select("node", F.col("node").alias("b"))))
        large = large.join(known.withColumnRenamed("component", "root"), "node")
        main = large.where("node = cluster").select("cluster", F.col("root").alias("main"))
        large = stage(large.join(main, "cluster"))
        outside = large.where("root <> main")
        chunks = outside.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / p.block).cast("int").alias("chunks"))
        outside = outside.join(chunks, "cluster").withColumn("against", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"))
        movers = outside.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        still = large.join(chunks, "cluster").withColumn("against", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        both = movers.withColumn("mover", F.lit(True)).unionByName(still.withColumn("mover", F.lit(False)))
        both = both.groupBy("cluster", "block", "against", "node", "root", "rep").agg(F.max("mover").alias("mover"))
        first = first.union(stage(links(both)))

    linked = components(first).withColumnRenamed("component", "group")
    group = ids.where("n_shingles > 0").join(linked, "node", "left").withColumn("group", F.coalesce("group", "node"))
    lowest = group.groupBy("group").agg(F.min("rep").alias("component_id"))
    answer = stage(group.join(lowest, "group").select("node", "component_id"))
    out = base.select("doc_id", "n_shingles", "node", "text_hash").join(answer, "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")


def drop_near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns.

    A row is known by doc_id and the hash of its text, so that of two texts of
    one doc_id only the copy goes. Rows equal in both are one document, and
    rows without a doc_id or without words all stay.
    """
    d, h = tb.spare(docs.columns, "_d"), tb.spare(docs.columns, "_h")
    gone = stage(near_duplicates(docs, params).where("NOT kept").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct())
    same = (F.col("doc_id").cast("long") == F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(h))
    return docs.join(gone.hint("merge"), same, "left_anti")
