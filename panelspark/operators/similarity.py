"""Exact cosine neighbours without comparing every pair of rows.

Similar pairs: dimensions are ordered by variance, and a unit vector is known to
the index by its first few and by the length of the rest. A pair can pass only
if the product of the prefixes plus the product of the two lengths does, which
is checked for whole boxes of vectors first and for single pairs then; only what
is left is scored on all dimensions.

Nearest rows: a ball tree of two levels. The centres of the leaves are learnt
from a bounded sample; every row belongs to the leaf of its nearest centre, and
the radius of a leaf covers all its rows. Rows of neighbouring leaves stand in
blocks of bounded size, each with small balls of its own. By the triangle
inequality for angles no row of a ball is nearer than the angle to its centre
less its radius, so blocks and balls that cannot improve the k-th row are left
out.

Equal vectors are compared once, leaves and boxes with very many rows are many
tasks, and what comes to the driver is bounded by parameters.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.stage import stage

# helpers of this module travel with the functions that call them
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 2048  # rows or queries of a block; a block of the pair index has up to four times as many
SAMPLE = 20_000  # rows that boxes and centres are learnt from; which rows they are changes the speed and not the result
LEAVES = 4096  # boxes or leaves at most
REACHED = 1 << 18  # distances of queries to leaves that one step holds
BALL = 64  # rows of a small ball at most
FAR = 1 << 62  # no distance yet
ASKED = ("at", "q_reps", "q_x", "q_norm", "q_leaf", "q_bound")  # a block of queries: its name, and the numbers of its rows as bytes
BLOCK = ("reps", "x", "norm", "rank", "ends", "centers", "radii", "leaves")  # a block of rows in the order of its balls, and where these end, lie and reach


def unit(vec: Column | str) -> Column:
    """The vector scaled to length 1; a zero vector stays zero."""
    v = F.transform(F.col(vec) if isinstance(vec, str) else vec, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def width(df: DataFrame, vec: str, empty: int = 1) -> int:
    row = df.select(F.size(vec).alias("n")).first()
    return row["n"] if row else empty


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of arrays as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _rows(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as a column of arrays."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.ravel()))


def _sampled(rows: DataFrame, dim: int) -> np.ndarray:
    """At most SAMPLE unit vectors, chosen by a hash of their names."""
    found = rows.select("rep", "u").orderBy(F.xxhash64("rep")).limit(SAMPLE).collect()
    return np.array([r["u"] for r in found], float).reshape(-1, dim)


# ---- similar pairs

def prefix_length(n: int, dim: int) -> int:
    """Dimensions that the index knows: more of them pay on larger tables."""
    return max(1, min(dim - 1, 8, round(math.log2(max(2, n)) / 4))) if dim > 1 else 1


def indexed(u: np.ndarray, order: list[int], p: int) -> np.ndarray:
    """The first p dimensions in ``order`` and the length of the rest."""
    rest = np.sqrt(np.maximum(0.0, (u[:, order[p:]] ** 2).sum(axis=1)))
    return np.column_stack([u[:, order[:p]], rest])


def split_boxes(w: np.ndarray, leaves: int) -> list[tuple]:
    """A tree of median cuts: (dimension, value, left, right) or (leaf number,)."""
    tree: list[tuple] = []
    count = 0

    def grow(rows, budget):
        nonlocal count
        at = len(tree)
        tree.append(())
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
        if budget < 2 or len(rows) < 2 or not spread.max():
            tree[at] = (count,)
            count += 1
            return at
        d = int(np.argmax(spread))
        value = float(np.median(rows[:, d]))
        low = rows[:, d] < value
        if not low.any():  # the median is the least value
            value = float(np.nextafter(value, np.inf))
            low = rows[:, d] < value
        left = grow(rows[low], budget // 2)
        right = grow(rows[~low], budget - budget // 2)
        tree[at] = (d, value, left, right)
        return at

    grow(w, leaves)
    return tree


def box_of(tree: list[tuple], w: np.ndarray) -> np.ndarray:
    out = np.zeros(len(w), np.int32)
    todo = [(0, np.arange(len(w)))]
    while todo:
        at, rows = todo.pop()
        node = tree[at]
        if len(node) == 1:
            out[rows] = node[0]
        elif len(rows):
            low = w[rows, node[0]] < node[1]
            todo += [(node[2], rows[low]), (node[3], rows[~low])]
    return out


def largest_product(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
    """The largest product of a vector in one box and a vector in each of the others, and no more than their distance allows."""
    each = np.maximum(np.maximum(lo * lo2, lo * hi2), np.maximum(hi * lo2, hi * hi2)).sum(axis=1)
    gap = np.maximum(0.0, np.maximum(lo2 - hi, lo - hi2))
    return np.minimum(each, 1 - (gap ** 2).sum(axis=1) / 2)  # unit vectors: |a - b|^2 = 2 - 2 ab


def blocks_in_reach(lo: Column, hi: Column, lo2: Column, hi2: Column, size: int, threshold: float) -> Column:
    """``largest_product`` of two blocks as a condition on their arrays of ``size`` bounds."""
    each = [F.greatest(lo[i] * lo2[i], lo[i] * hi2[i], hi[i] * lo2[i], hi[i] * hi2[i]) for i in range(size)]
    gap = [F.greatest(F.lit(0.0), lo2[i] - hi[i], lo[i] - hi2[i]) for i in range(size)]
    most = F.least(sum(each, F.lit(0.0)), 1 - sum((g * g for g in gap), F.lit(0.0)) / 2)
    return most >= threshold - 1e-9


def cut(w: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of small cells of about ``most`` rows, where the cells begin, and how far each reaches."""
    at = box_of(split_boxes(w, max(1, len(w) // most)), w)
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.diff(at[order], prepend=-1))
    return order, np.append(starts, len(w)), np.minimum.reduceat(w[order], starts), np.maximum.reduceat(w[order], starts)


def in_reach(left: tuple, right: tuple, threshold: float):
    """Cells of one block, each with the places in the other block that can be similar to one of its rows."""
    (_, starts1, lo1, hi1), (_, starts2, lo2, hi2) = left, right
    for i in range(len(lo1)):
        near = np.flatnonzero(largest_product(lo1[i], hi1[i], lo2, hi2) >= threshold - 1e-9)
        if len(near):
            yield np.arange(starts1[i], starts1[i + 1]), np.concatenate([np.arange(starts2[k], starts2[k + 1]) for k in near])


def opened(rows: pa.StructArray, dim: int, order: list[int], p: int, most: int) -> tuple:
    """Unit vectors, what the index knows of them and their lengths, in the order of the block's cells, and the cells."""
    norm = rows.field("norm").to_numpy()
    u = _matrix(rows.field("x"), dim) / norm[:, None]
    w = indexed(u, order, p)
    cells = cut(w, most)
    return u[cells[0]], w[cells[0]], norm[cells[0]], cells


@dataclass
class SimilarIndex:
    """Classes of equal vectors dealt over boxes.

    ``placed`` has (rep, x, u, norm, w, box): the vector as it came, scaled, its
    length, what the index knows of it, and its box; ``boxes`` has the number of
    blocks (box, parts) that each is cut into. The blocks are written once, as
    vectors of the type they came in. Tasks read the two blocks that they
    compare from there, so that no row is shuffled once per block that it meets
    and the disk grows with the rows. Inside a task blocks are cut into small
    cells, and only cells in reach of each other are compared.
    """

    placed: DataFrame
    boxes: DataFrame
    threshold: float
    dim: int
    order: list[int]
    p: int

    def _meets(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        size = self.p + 1
        count = self.boxes.agg(F.sum("parts").alias("n")).first()["n"] or 1
        chunks = stage(rows.join(self.boxes, "box").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
                       .repartition(min(1000, count), "box", "part").groupBy("box", "part").agg(
            F.collect_list(F.struct(*columns)).alias("rows"), F.array(*[F.min(F.col("w")[i]) for i in range(size)]).alias("lo"),
            F.array(*[F.max(F.col("w")[i]) for i in range(size)]).alias("hi")))
        left, right = (chunks.select(F.struct("box", "part").alias(f"at{k}"), F.col("rows").alias(f"r{k}"), F.col("lo").alias(f"lo{k}"), F.col("hi").alias(f"hi{k}"))
                       for k in (1, 2))
        near = blocks_in_reach(F.col("lo1"), F.col("hi1"), F.col("lo2"), F.col("hi2"), size, self.threshold)
        # a task per pair of file splits, which reads both: neither side is shuffled or broadcast
        meets = left.join(right.hint("shuffle_replicate_nl"), (F.col("at1") <= F.col("at2")) & near)
        return meets.select("r1", "r2", (F.col("at1") == F.col("at2")).alias("same"))

    def found(self) -> DataFrame:
        """(src, dst, weight, met, scored): every similar pair, and rows without a pair that count the work."""
        threshold, known = self.threshold, (self.dim, self.order, self.p, max(1, CHUNK // 8))
        kind = self.placed.schema["rep"].dataType
        names = _arrow(kind)

        def compare(batches):
            for batch in batches:
                for r1, r2, is_same in zip(batch.column("r1"), batch.column("r2"), batch.column("same").to_pylist()):
                    (u1, w1, n1, cells1), (u2, w2, n2, cells2) = opened(r1.values, *known), opened(r2.values, *known)
                    names1, names2 = (r.values.field("rep").to_numpy(zero_copy_only=False)[cells[0]] for r, cells in ((r1, cells1), (r2, cells2)))
                    for rows, others in in_reach(cells1, cells2, threshold):
                        bound = w1[rows] @ w2[others].T >= threshold - 1e-9
                        if is_same:
                            bound &= rows[:, None] < others
                        scored = int(np.count_nonzero(bound))
                        if scored * 10 < bound.size:
                            i, j = np.nonzero(bound)
                            sims = np.einsum("ij,ij->i", u1[rows[i]], u2[others[j]])
                        else:  # the 1e-6 beside the lengths only lowers a cosine
                            sims = u1[rows] @ u2[others].T
                            bound &= sims > threshold - 1e-9
                            i, j = np.nonzero(bound)
                            sims = sims[i, j]
                        i, j = rows[i], others[j]
                        size = n1[i] * n2[j]
                        sims = sims * size / (size + 1e-6)
                        good = sims > threshold
                        a, b = names1[i[good]], names2[j[good]]
                        swap = a > b
                        ends = [pa.concat_arrays([pa.nulls(1, names), pa.array(x, names)]) for x in (np.where(swap, b, a), np.where(swap, a, b))]
                        yield pa.RecordBatch.from_arrays([*ends, pa.array(np.append([0.0], sims[good])), pa.array(np.append([bound.size], np.zeros(len(a), np.int64))),
                                                          pa.array(np.append([scored], np.zeros(len(a), np.int64)))], names=["src", "dst", "weight", "met", "scored"])

        schema = T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("weight", T.DoubleType()),
                               T.StructField("met", T.LongType()), T.StructField("scored", T.LongType())])
        return self._meets(self.placed, ["rep", "x", "norm"]).mapInArrow(compare, schema)

    def sums(self, values: DataFrame, weighted: bool = True) -> DataFrame:
        """(rep, sums): the arrays ``v`` of ``values`` (rep, v) added up over all similar classes, times the cosine where ``weighted``.

        Only classes in ``values`` take part. No pair is written: a task adds up
        what two blocks give to each other's rows.
        """
        threshold, known = self.threshold, (self.dim, self.order, self.p, max(1, CHUNK // 8))
        n_values = width(values, "v")
        kind = self.placed.schema["rep"].dataType

        def add(batches):
            for batch in batches:
                for r1, r2, is_same in zip(batch.column("r1"), batch.column("r2"), batch.column("same").to_pylist()):
                    (u1, _, n1, cells1), (u2, _, n2, cells2) = opened(r1.values, *known), opened(r2.values, *known)
                    names1, names2 = (r.values.field("rep").take(pa.array(cells[0])) for r, cells in ((r1, cells1), (r2, cells2)))
                    v1, v2 = (_matrix(r.values.field("v"), n_values)[cells[0]] for r, cells in ((r1, cells1), (r2, cells2)))
                    to1, to2 = np.zeros_like(v1), np.zeros_like(v2)
                    for rows, others in in_reach(cells1, cells2, threshold):
                        size = n1[rows][:, None] * n2[others]
                        sims = (u1[rows] @ u2[others].T) * size / (size + 1e-6)
                        good = sims > threshold
                        if is_same:
                            good &= rows[:, None] < others
                        each = np.where(good, sims, 0.0) if weighted else good.astype(float)
                        to1[rows] += each @ v2[others]
                        to2[others] += each.T @ v1[rows]
                    for names, got in ((names1, to1), (names2, to2)):
                        some = np.flatnonzero((got != 0).any(axis=1))
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), _rows(got[some])], names=["rep", "sums"])

        meets = self._meets(self.placed.join(values.select("rep", "v"), "rep"), ["rep", "x", "norm", "v"])
        parts = meets.mapInArrow(add, T.StructType([T.StructField("rep", kind), T.StructField("sums", T.ArrayType(T.DoubleType()))]))
        return parts.groupBy("rep").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(n_values)]).alias("sums"))

    def similarity(self, u1: Column, n1: Column, u2: Column, n2: Column) -> Column:
        """The cosine of two vectors where it is above the threshold, else null."""
        value = dot(u1, u2) * (n1 * n2) / (n1 * n2 + 1e-6)
        return F.when(value > self.threshold, value)


def similar_index(df: DataFrame, id_col: str, vec: str, threshold: float = 0.8) -> tuple[SimilarIndex, DataFrame]:
    """(index of the classes of equal vectors, classes of the ids).

    The class table is (id, rep, copy_weight); a class bears the least of its
    ids, and copy_weight is the cosine of a vector with its copy, or 0 where that
    is not above the threshold. Zero vectors have no class.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    dim = width(df, vec)
    text = F.concat_ws(",", F.transform(vec, lambda x: (x + F.lit(0.0)).cast("string")))
    kind = "float" if df.schema[vec].dataType.elementType.typeName() == "float" else "double"  # floats stay floats: half the disk
    ids = df.select(F.col(id_col).alias("id"), F.md5(text).alias("_hash"))
    vectors = df.select(F.col(id_col).alias("id"), F.md5(text).alias("_hash"), F.transform(vec, lambda x: F.coalesce(x, F.lit(0)).cast(kind)).alias("x"))
    wide = F.transform("x", lambda x: x.cast("double"))
    reps = stage(vectors.groupBy("_hash").agg(F.min("id").alias("rep"), F.first("x").alias("x"))
                 .withColumn("norm", F.sqrt(dot(wide, wide))).where(F.col("norm") > 0))
    scaled = F.transform("x", lambda x: x / F.col("norm")).alias("u")
    # one row of dim + 1 numbers
    spread = reps.agg(F.count("*").alias("n"), *[F.coalesce(F.var_pop(F.col("x")[i] / F.col("norm")), F.lit(0.0)).alias(f"v{i}") for i in range(dim)]).first()
    n, order = spread["n"], sorted(range(dim), key=lambda i: (-spread[f"v{i}"], i))
    p = prefix_length(n, dim)
    tree = split_boxes(indexed(_sampled(reps.select("rep", scaled), dim), order, p), max(1, min(LEAVES, n // (4 * CHUNK))))

    def place(batches):
        for batch in batches:
            w = indexed(_matrix(batch.column("x"), dim) / batch.column("norm").to_numpy()[:, None], order, p)
            yield batch.append_column("w", _rows(w)).append_column("box", pa.array(box_of(tree, w)))

    vectors = reps.select("rep", "x", "norm")
    placed = vectors.mapInArrow(place, T.StructType([*vectors.schema.fields, T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("box", T.IntegerType())]))
    boxes = stage(placed.groupBy("box").agg(F.ceil(F.count("*") / (4 * CHUNK)).cast("int").alias("parts")))
    copy = F.col("norm") * F.col("norm") / (F.col("norm") * F.col("norm") + 1e-6)
    weights = reps.select("_hash", "rep", F.when(copy > threshold, copy).otherwise(0.0).alias("copy_weight"))
    known = ids.join(weights, "_hash").select("id", "rep", "copy_weight")
    return SimilarIndex(placed.select("rep", "x", scaled, "norm", "w", "box"), boxes, threshold, dim, order, p), known


def similar_pairs(df: DataFrame, id_col: str, vec: str, threshold: float = 0.8, report: bool = False):
    """(pairs of classes with cosine above the threshold, classes of the ids), and with ``report`` the work done.

    The cosine is dot / (norms + 1e-6). Every unordered pair of classes stands
    once as (src, dst, weight), smaller name first. Ids of one class are equal
    vectors; they are not written out as pairs, since n copies have n * n. For
    the class table see ``similar_index``. The work is one row: classes, pairs
    that met the prefix bound in the index, pairs scored on all dimensions.
    """
    index, known = similar_index(df, id_col, vec, threshold)
    found = stage(index.found()) if report else index.found()
    pairs = found.where("src IS NOT NULL").select("src", "dst", "weight")
    if not report:
        return pairs, known
    none = F.lit(0).cast("long")
    n = index.placed.count()
    return pairs, known, found.agg(F.lit(n).cast("long").alias("classes"), F.coalesce(F.sum("met"), none).alias("met"), F.coalesce(F.sum("scored"), none).alias("scored"))


# ---- nearest rows

def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between the unit vectors of two matrices."""
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def grow_balls(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of unit vectors cut in two, and again, until no ball holds more than ``most``; equal vectors stay together."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        y = x[rows]
        a = y[np.argmin(y @ y.mean(axis=0))]  # far from the middle, and then far from there
        b = y[np.argmin(y @ a)]
        for _ in range(4):
            first = y @ a >= y @ b
            if first.all() or not first.any():
                break
            a, b = (z / max(1e-12, np.linalg.norm(z)) for z in (y[first].mean(axis=0), y[~first].mean(axis=0)))
        if first.all() or not first.any():
            out += [rows[i:i + most] for i in range(0, len(rows), most)]
        else:
            todo += [rows[first], rows[~first]]
    return out


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and radius in radians of unit vectors."""
    c = x.mean(axis=0)
    c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-9 else x[0]
    return c, float(angle(x, c[None]).max()) + 1e-9


def _reach(distance: np.ndarray) -> np.ndarray:
    """The angle within which a row must lie to be at most as far; the slack covers rounded distances."""
    return np.where(np.isfinite(distance), np.arccos(np.clip(1 - (np.where(np.isfinite(distance), distance, 0) + 1e-8), -1.0, 1.0)) + 1e-6, np.pi + 1)


def _packed(a: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def _pieces(batches, size: int):
    """The rows of the batches as tables of ``size`` rows."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            batch, n = batch.slice(part.num_rows), n + part.num_rows
            held.append(part)
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Rows in the order of their leaves, in files of even size, however many rows a leaf has."""
    return rows.repartitionByRange(max(1, min(256, -(-n // CHUNK))), "leaf", F.xxhash64("rep")).sortWithinPartitions("leaf")


def _base_blocks(settled: DataFrame, n: int, dim: int) -> DataFrame:
    """Blocks of at most CHUNK rows of neighbouring leaves with their small balls, none of which has rows of two leaves."""
    size, real = CHUNK, np.float32 if settled.schema["x"].dataType.elementType.typeName() == "float" else np.float64

    def pack(batches):
        before = None
        for table in _pieces(batches, size):
            x, norm, leaf = _matrix(table["x"], dim), table["norm"].to_numpy(), table["leaf"].to_numpy()
            u = x / norm[:, None]
            edges = np.flatnonzero(np.diff(leaf, prepend=leaf[0] - 1, append=leaf[-1] + 1))
            balls = [a + rows for a, b in zip(edges, edges[1:]) for rows in grow_balls(u[a:b], BALL)]
            order, found = np.concatenate(balls), [_ball(u[rows]) for rows in balls]
            center, radius = _ball(u)
            rank = pc.rank(table["rep"], sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
            yield pa.RecordBatch.from_pylist([{
                "reps": table["rep"].take(pa.array(order)).to_pylist(), "x": _packed(x[order], real), "norm": _packed(norm[order], float), "rank": _packed(rank[order], np.int32),
                "ends": _packed(np.cumsum([0, *map(len, balls)]), np.int32), "centers": _packed([c for c, _ in found], float), "radii": _packed([r for _, r in found], float),
                "leaves": _packed([leaf[rows[0]] for rows in balls], np.int32), "c": center.tolist(), "r": radius, "lo": int(leaf[0]), "hi": int(leaf[-1]),
                "opens": bool(before is None or leaf[-1] != before)}], schema=arrow)
            before = leaf[-1]

    fields = [T.StructField("reps", T.ArrayType(settled.schema["rep"].dataType)), *[T.StructField(c, T.BinaryType()) for c in BLOCK[1:]], T.StructField("c", T.ArrayType(T.DoubleType())),
              T.StructField("r", T.DoubleType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("opens", T.BooleanType())]
    arrow = _arrow_schema(T.StructType(fields))
    return stage(_dealt(settled, n).mapInArrow(pack, T.StructType(fields)))


def _query_blocks(started: DataFrame, n: int, dim: int) -> DataFrame:
    """Blocks of at most CHUNK queries of neighbouring leaves, each query with the angle within which its rows lie."""
    size, real = CHUNK, np.float32 if started.schema["x"].dataType.elementType.typeName() == "float" else np.float64

    def pack(batches):
        at = TaskContext.get().partitionId()
        for i, table in enumerate(_pieces(batches, size)):
            x, norm, leaf, bound = _matrix(table["x"], dim), table["norm"].to_numpy(), table["leaf"].to_numpy(), table["bound"].to_numpy()
            center, radius = _ball(x / norm[:, None])
            yield pa.RecordBatch.from_pylist([{
                "at": f"{at}-{i}", "q_reps": table["rep"].to_pylist(), "q_x": _packed(x, real), "q_norm": _packed(norm, float), "q_leaf": _packed(leaf, np.int32),
                "q_bound": _packed(bound, float), "q_c": center.tolist(), "q_r": radius, "q_b": float(bound.max()), "q_lo": int(leaf[0]), "q_hi": int(leaf[-1])}], schema=arrow)

    fields = [T.StructField("at", T.StringType()), T.StructField("q_reps", T.ArrayType(started.schema["rep"].dataType)), *[T.StructField(c, T.BinaryType()) for c in ASKED[2:]],
              T.StructField("q_c", T.ArrayType(T.DoubleType())), T.StructField("q_r", T.DoubleType()), T.StructField("q_b", T.DoubleType()), T.StructField("q_lo", T.IntegerType()),
              T.StructField("q_hi", T.IntegerType())]
    arrow = _arrow_schema(T.StructType(fields))
    return stage(_dealt(started, n).mapInArrow(pack, T.StructType(fields)))


class _Asked:
    """The queries of one block and the best rows found for them so far."""

    def __init__(self, batch: pa.RecordBatch, i: int, dim: int, real, k: int):
        binary = {c: batch.column(c)[i].as_buffer() for c in ASKED[2:]}
        self.at, self.names, self.k, self.dim, self.real, self.scored = batch.column("at")[i].as_py(), batch.column("q_reps")[i].values, k, dim, real, 0
        self.u = np.frombuffer(binary["q_x"], real).reshape(-1, dim) / np.frombuffer(binary["q_norm"])[:, None]
        self.leaf, self.bound = np.frombuffer(binary["q_leaf"], np.int32), np.frombuffer(binary["q_bound"]).copy()
        self.best = np.full((len(self.u), k), FAR)  # distances * 1e9
        self.kept: list[tuple] = []  # (queries, distances * 1e9, names)

    def meet(self, batch: pa.RecordBatch, i: int, home: bool) -> None:
        """Look through one block of rows; with ``home`` only through the query's own leaf."""
        binary = {c: batch.column(c)[i].as_buffer() for c in BLOCK[1:]}
        centers, radii, ends = np.frombuffer(binary["centers"]).reshape(-1, self.dim), np.frombuffer(binary["radii"]), np.frombuffer(binary["ends"], np.int32)
        cos = np.cos(np.minimum(self.bound[:, None] + radii, np.pi))
        near = self.u @ centers.T >= cos - 1e-9
        if home:
            near &= self.leaf[:, None] == np.frombuffer(binary["leaves"], np.int32)
        if not near.any():
            return
        x = np.frombuffer(binary["x"], self.real).reshape(-1, self.dim) / np.frombuffer(binary["norm"])[:, None]
        rank, names = np.frombuffer(binary["rank"], np.int32), batch.column("reps")[i].values
        if near.mean() > 0.5:  # one product costs less than one per ball
            self._score(np.flatnonzero(near.any(axis=1)), np.arange(len(x)), x, rank, names)
            return
        for ball in np.argsort(-near.sum(axis=0), kind="stable"):
            ask = np.flatnonzero(near[:, ball])
            if len(ask):
                self._score(ask, np.arange(ends[ball], ends[ball + 1]), x, rank, names)

    def _score(self, ask, rows, x, rank, names) -> None:
        k = self.k
        self.scored += len(ask) * len(rows)
        sims = self.u[ask] @ x[rows].T
        least = np.cos(np.minimum(self.bound[ask], np.pi)) - 1e-9
        good = sims >= least[:, None]
        if np.count_nonzero(good) > 2 * k * len(ask) and len(rows) > k:
            good &= sims >= np.partition(sims, -k, axis=1)[:, -k][:, None] - 1e-8
        i, j = np.nonzero(good)
        if not len(i):
            return
        d = np.rint(np.clip(1 - sims[i, j], 0, 2) * 1e9).astype(np.int64)
        i, j = ask[i], rows[j]
        some = d <= self.best[i, k - 1]
        i, j, d = i[some], j[some], d[some]
        order, place = _firsts(i, d, rank[j], k)
        i, j, d = i[order], j[order], d[order]
        if not len(i):
            return
        self.kept.append((i, d, names.take(pa.array(j))))
        met, row = np.unique(i, return_inverse=True)
        found = np.full((len(met), 2 * k), FAR)
        found[:, :k] = self.best[met]
        found[row, k + place] = d
        found.sort(axis=1)
        self.best[met] = found[:, :k]
        kth = found[:, k - 1]
        self.bound[met] = np.minimum(self.bound[met], _reach(np.where(kth < FAR, kth / 1e9, np.inf)))
        if sum(len(x[0]) for x in self.kept) > max(1 << 16, 4 * k * len(self.u)):
            self.kept = [self.nearest()]

    def nearest(self) -> tuple:
        """(queries, distances * 1e9, names) of the k best rows of each query so far."""
        if not self.kept:
            return np.zeros(0, int), np.zeros(0, np.int64), self.kept
        i, d = (np.concatenate([x[c] for x in self.kept]) for c in (0, 1))
        names = pa.concat_arrays([x[2] for x in self.kept])
        order, _ = _firsts(i, d, pc.rank(names, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(), self.k)
        return i[order], d[order], names.take(pa.array(order))


def _firsts(group: np.ndarray, *by_and_k) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first k of each group in the order of the other keys, and their place in the group."""
    *by, k = by_and_k
    order = np.lexsort((*by[::-1], group))
    g = group[order]
    begins = np.flatnonzero(np.diff(g, prepend=-1))
    place = np.arange(len(g)) - np.repeat(begins, np.diff(np.append(begins, len(g))))
    return order[place < k], place[place < k]


def _meeting(asked: DataFrame, base: DataFrame, condition: Column, step, schema: T.StructType) -> DataFrame:
    """``step`` over the pairs of blocks that meet: a task per pair of file splits reads both, and nothing is shuffled or broadcast."""
    return asked.join(base.hint("shuffle_replicate_nl"), condition).select(*ASKED, *BLOCK).mapInArrow(step, schema)


def _tightened(asked: DataFrame, base: DataFrame, dim: int, real, k: int) -> tuple[DataFrame, DataFrame]:
    """(blocks of queries bounded by the k-th row of their own leaf, pairs scored for it)."""
    def look(batches):
        for block in _streams(batches, dim, real, k, True):
            yield pa.RecordBatch.from_pydict({"at": [block.at], "b": [_packed(block.bound, float)], "scored": [block.scored]}, schema=pa.schema(
                {"at": pa.string(), "b": pa.binary(), "scored": pa.int64()}))

    # of the blocks of a leaf with many rows, those that begin a file or end another leaf will do
    own = (F.col("lo") <= F.col("q_hi")) & (F.col("q_lo") <= F.col("hi")) & F.col("opens")
    seen = stage(_meeting(asked, base, own, look, T.StructType([T.StructField("at", T.StringType()), T.StructField("b", T.BinaryType()), T.StructField("scored", T.LongType())])))
    arrow, names = _arrow_schema(asked.schema), asked.columns

    def tighten(batches):
        for batch in batches:
            bounds = [np.min([np.frombuffer(b) for b in [own, *(more or [])]], axis=0) for own, more in zip(batch.column("q_bound").to_pylist(), batch.column("bs").to_pylist())]
            columns = {c: batch.column(c) for c in names} | {"q_bound": pa.array([_packed(b, float) for b in bounds], pa.binary()), "q_b": pa.array([float(b.max()) for b in bounds])}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)

    joined = asked.join(seen.groupBy("at").agg(F.collect_list("b").alias("bs")), "at", "left")
    return stage(joined.mapInArrow(tighten, asked.schema)), seen.agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"))


def _streams(batches, dim: int, real, k: int, home: bool):
    """Each block of queries of a task after it has met its blocks of rows, which come one after the other."""
    block = None
    for batch in batches:
        for i, at in enumerate(batch.column("at").to_pylist()):
            if block is None or block.at != at:
                if block is not None:
                    yield block
                block = _Asked(batch, i, dim, real, k)
            block.meet(batch, i, home)
    if block is not None:
        yield block


def nearest(queries: DataFrame, base: DataFrame, id_col: str, vec: str, k: int = 5, report: bool = False):
    """The k nearest base rows of every query row by cosine distance: (query, neighbour, distance, rank), and with ``report`` the work done.

    Exact. A query's own leaf is searched first, which bounds the k-th distance;
    then every small ball that comes within the bound. Queries and rows are
    written once in blocks of neighbouring leaves, and a task reads the blocks
    that it compares from there: nothing but what was found is shuffled, so the
    disk grows with the rows. Ties follow the neighbour's id. A zero vector is at
    distance 1 from all rows, a row without a vector is none. The work is one
    row: pairs of a query and a row in all, and pairs scored.
    """
    dim = next((n for n in (width(df.where(F.col(vec).isNotNull()), vec, 0) for df in (base, queries)) if n), 1)
    id_type = base.schema[id_col].dataType
    kind = "float" if all(df.schema[vec].dataType.elementType.typeName() == "float" for df in (queries, base)) else "double"  # floats stay floats: half the disk
    real = np.float32 if kind == "float" else np.float64
    plain = T.StructType([T.StructField("rep", id_type), T.StructField("x", T.ArrayType(T.FloatType() if kind == "float" else T.DoubleType())), T.StructField("norm", T.DoubleType())])
    placed = T.StructType([*plain.fields, T.StructField("leaf", T.IntegerType()), T.StructField("a", T.DoubleType())])

    def measure(batches):
        for batch in batches:
            x, squares = _matrix(batch.column("x"), dim).astype(float), np.zeros(batch.num_rows)
            for i in range(dim):  # in the order of the dimensions, as a sum over the array has it
                squares += x[:, i] * x[:, i]
            yield batch.append_column("norm", pa.array(np.sqrt(squares)))

    def measured(df):
        x = F.transform(vec, lambda v: F.coalesce(v, F.lit(0)).cast(kind)).alias("x")
        return df.where(F.col(vec).isNotNull()).select(F.col(id_col).cast(id_type).alias("rep"), x).mapInArrow(measure, plain)

    rows = stage(measured(base))
    train = rows.where("norm > 0")
    flat = stage(rows.where("NOT norm > 0").select("rep").orderBy("rep").limit(k))  # of equal distances the first k count
    n_train = train.count()
    sample = _sampled(train.select("rep", F.transform("x", lambda x: x / F.col("norm")).alias("u")), dim)
    leaves = grow_balls(sample, max(1, -(-len(sample) // max(1, min(LEAVES, n_train // 256)))))
    centers = np.array([_ball(sample[r])[0] for r in leaves if len(r)]).reshape(-1, dim)

    def settle(batches):
        step = max(1, min(1024, REACHED // max(1, len(centers))))
        for batch in batches:
            u = _matrix(batch.column("x"), dim) / batch.column("norm").to_numpy()[:, None]
            leaf, a = np.zeros(len(u), np.int32), np.zeros(len(u))
            for i in range(0, len(u), step):
                d = angle(u[i:i + step], centers)
                leaf[i:i + step], a[i:i + step] = d.argmin(axis=1), d.min(axis=1)
            yield batch.append_column("leaf", pa.array(leaf)).append_column("a", pa.array(a))

    settled = stage(train.mapInArrow(settle, placed))
    held = settled.groupBy("leaf").agg(F.max("a").alias("radius"), F.count("*").alias("n")).orderBy("leaf").collect()  # at most LEAVES rows, or one per sampled row
    known = np.array([r["leaf"] for r in held], np.int32)
    radius, count = (np.array([r[c] for r in held]) for c in ("radius", "n"))
    middle = centers[known] if len(known) else centers

    def reached(batches):
        """The leaf of each query, and the angle within which the leaves must have k rows."""
        per_step = max(1, min(1024, REACHED // max(1, len(known))))
        for batch in batches:
            norm = batch.column("norm").to_numpy()
            u = _matrix(batch.column("x"), dim) / np.where(norm > 0, norm, 1.0)[:, None]
            home, first = np.zeros(len(u), np.int32), np.full(len(u), np.pi + 1)
            for at in range(0, len(u) if len(known) else 0, per_step):
                a = angle(u[at:at + per_step], middle)
                upper = a + radius + 1e-9
                by = np.argsort(upper, axis=1)
                enough = np.cumsum(count[by], axis=1) >= k
                first[at:at + per_step] = np.where(enough.any(axis=1), np.take_along_axis(upper, by, 1)[np.arange(len(a)), enough.argmax(axis=1)], np.pi + 1) + 1e-6
                home[at:at + per_step] = known[a.argmin(axis=1)]
            yield batch.append_column("leaf", pa.array(home)).append_column("bound", pa.array(first))

    asks = stage(measured(queries).mapInArrow(reached, T.StructType([*placed.fields[:-1], T.StructField("bound", T.DoubleType())])))
    moving = asks.where("norm > 0")
    n_asks = moving.count()
    result_type = T.StructType([T.StructField("query", id_type), T.StructField("neighbour", id_type), T.StructField("distance", T.DoubleType()), T.StructField("scored", T.LongType())])
    if n_train and n_asks:
        blocks = _base_blocks(settled, n_train, dim)
        asked, first = _tightened(_query_blocks(moving, n_asks, dim), blocks, dim, real, k)
        arrow = _arrow_schema(result_type)

        def search(batches):
            """The best rows of a block of queries; a row without a query counts the work."""
            for block in _streams(batches, dim, real, k, False):
                i, d, names = block.nearest()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, arrow[0].type), pa.nulls(1, arrow[1].type), pa.array([0.0]), pa.array([block.scored], pa.int64())], schema=arrow)
                if len(i):
                    yield pa.RecordBatch.from_arrays([block.names.take(pa.array(i)).cast(arrow[0].type), names.cast(arrow[1].type), pa.array(d / 1e9), pa.array(np.zeros(len(i), np.int64))], schema=arrow)

        cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("c"), F.col("q_c"))))
        found = _meeting(asked, blocks, F.acos(cosine) <= F.col("q_r") + F.col("r") + F.col("q_b") + 1e-9, search, result_type)
        found = stage(found) if report else found
    else:
        found = moving.where("false").select(F.col("rep").alias("query"), F.col("rep").alias("neighbour"), F.lit(1.0).alias("distance"), F.lit(0).cast("long").alias("scored"))
    # rows at a right angle: zero vectors in the base, k of them at most, and for a zero query the first k of all
    one, none = F.lit(1.0).alias("distance"), F.lit(0).cast("long").alias("scored")
    to_flat = moving.join(F.broadcast(flat.select(F.col("rep").alias("neighbour"))), F.lit(True)).select(F.col("rep").alias("query"), "neighbour", one, none)
    least = stage(base.select(F.col(id_col).alias("neighbour")).orderBy("neighbour").limit(k))
    from_zero = asks.where("NOT norm > 0").join(F.broadcast(least), F.lit(True)).select(F.col("rep").alias("query"), "neighbour", one, none)
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    kept = found.where("query IS NOT NULL").unionByName(to_flat).unionByName(from_zero)
    result = kept.select("query", "neighbour", "distance", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
    if not report:
        return result
    scored = found.agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"))
    if n_train and n_asks:
        scored = scored.unionByName(first).agg(F.sum("scored").alias("scored"))
    return result, scored.select(F.lit(n_asks * n_train).cast("long").alias("pairs"), F.col("scored").cast("long"))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in schema.fields])
