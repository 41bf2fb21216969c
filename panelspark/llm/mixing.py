"""Mixing sources to target weights as a min-cost flow over membership patterns.

Documents that belong to the same sources are one pattern. A pattern can send
its tokens once for nothing and again at a rising price per repetition; a source
takes up to its target. The flow over the aggregated patterns says how often
each pattern is taken, and a seeded order of its documents makes that whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions.stage import stage
from panelspark.llm import textbytes as tb

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    """The mix has ``share`` times all sizes; nothing is taken more than ``repeats`` times.

    Sources in code point order (null last) get ``weights`` in turn. At most
    ``max_patterns`` distinct sets of sources are supported.
    """
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    repeats: int = 2
    seed: str = "mix-1"
    max_patterns: int = 50_000


def targets(sizes: list[float], weights: list[float], total: float, repeats: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``repeats`` times its size; what is cut off is shared again."""
    order = sorted(range(len(sizes)), key=lambda i: (repeats * sizes[i] / weights[i], i))
    out, left, weight = [0.0] * len(sizes), total, sum(weights)
    for k, i in enumerate(order):
        if repeats * sizes[i] / weights[i] <= left / weight:
            out[i] = float(repeats * sizes[i])
            left, weight = left - out[i], weight - weights[i]
        else:
            for j in order[k:]:
                out[j] = left * weights[j] / weight
            break
    return out


def route(patterns: list[tuple[tuple[int, ...], float]], quotas: list[float], repeats: int) -> list[dict[int, float]]:
    """Per pattern the tokens it sends to each of its sources: the cheapest of the largest flows.

    Sending a pattern's tokens for the k-th time costs k - 1 a token, so
    repetition is spread before it is deepened. All other links are free, so a
    cheapest path costs what its first link costs, and one price level after
    another is a largest flow that begins at the flow of the level before it.
    """
    tiny = 1e-9 * (1.0 + sum(quotas))
    sent: list[dict[int, float]] = [dict.fromkeys(sources, 0.0) for sources, _ in patterns]
    by_source: list[set[int]] = [set() for _ in quotas]  # patterns with tokens at a source
    room = [float(q) for q in quotas]
    left = [0.0] * len(patterns)
    for _ in range(repeats):
        left = [a + float(size) for a, (_, size) in zip(left, patterns)]
        while _blocking(sent, by_source, room, left, tiny):
            pass
    return [{s: x for s, x in row.items() if x > tiny} for row in sent]


def _blocking(sent, by_source, room, left, tiny: float) -> bool:
    """One phase of largest flow: layers of patterns and sources by distance, then every path along them until none is left.

    A path leads from a pattern with tokens left to a source with room, and in
    between moves tokens that a pattern has at one source to another of its
    sources.
    """
    depth, sdepth = {i: 0 for i, x in enumerate(left) if x > tiny}, {}
    layer, goal = list(depth), False
    while layer and not goal:
        reached = []
        for i in layer:
            for s in sent[i]:
                if s not in sdepth:
                    sdepth[s] = depth[i]
                    reached.append(s)
                    goal = goal or room[s] > tiny
        layer = []
        if not goal:
            for s in reached:
                for j in by_source[s]:
                    if j not in depth:
                        depth[j] = sdepth[s] + 1
                        layer.append(j)
    if not goal:
        return False
    order, at = {i: list(sent[i]) for i in depth}, dict.fromkeys(depth, 0)
    holders: dict[int, list[int]] = {}
    held = dict.fromkeys(sdepth, 0)

    def path_from(root: int) -> list[int] | None:
        """Pattern, source, pattern, source, ... up to a source with room; what leads nowhere is never tried again."""
        path = [root]
        while True:
            i = path[-1]
            if at[i] == len(order[i]):
                if len(path) == 1:
                    return None
                del path[-1]
                held[path.pop()] += 1
                continue
            s = order[i][at[i]]
            if sdepth.get(s) == depth[i]:
                if room[s] > tiny:
                    return [*path, s]
                own = holders.setdefault(s, list(by_source[s]))
                while held[s] < len(own) and not (depth.get(own[held[s]]) == depth[i] + 1 and sent[own[held[s]]][s] > tiny):
                    held[s] += 1
                if held[s] < len(own):
                    path += [s, own[held[s]]]
                    continue
            at[i] += 1

    for root in [i for i, d in depth.items() if d == 0]:
        while left[root] > tiny and (path := path_from(root)):
            amount = min(left[root], room[path[-1]], *(sent[path[k]][path[k - 1]] for k in range(2, len(path), 2)))
            left[root] -= amount
            room[path[-1]] -= amount
            for k in range(0, len(path), 2):
                i, s = path[k], path[k + 1]
                sent[i][s] += amount
                by_source[s].add(i)
                if k:
                    sent[i][path[k - 1]] -= amount
                    if sent[i][path[k - 1]] <= tiny:
                        by_source[path[k - 1]].discard(i)
    return True


def _measured(docs: DataFrame, p: MixParams, sources: str) -> dict:
    """The columns that the mix works with: size, sources as an array, place in the seeded order."""
    if dict(docs.dtypes)[sources].startswith("array"):
        pattern = F.array_sort(F.array_distinct(F.coalesce(F.col(sources).cast("array<string>"), F.array(F.lit(None).cast("string")))))
    else:
        pattern = F.array(F.col(sources).cast("string"))
    order = F.md5(F.concat(F.lit(p.seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return {"_size": size, "_sources": pattern, "_u": order}


def plan_mix(base: DataFrame, p: MixParams) -> DataFrame:
    """Per set of sources: how often all its documents are taken, and up to where in the seeded order once more.

    ``base`` has _size, _sources and _u and is read four times. The result has
    one row per set of sources.
    """
    spark = base.sparkSession
    sums = base.groupBy("_sources").agg(F.sum("_size").alias("size")).limit(p.max_patterns + 1).collect()  # bounded by max_patterns
    if len(sums) > p.max_patterns:
        raise ValueError(f"more than {p.max_patterns} different sets of sources")
    names = sorted({s for r in sums for s in r["_sources"]}, key=lambda s: (s is None, s or ""))
    index = {s: i for i, s in enumerate(names)}
    sizes, shared = [0] * len(names), [0] * len(names)
    for r in sums:
        for s in r["_sources"]:
            sizes[index[s]] += r["size"]
            shared[index[s]] += 1
    weights = [p.weights[i % len(p.weights)] for i in range(len(names))]
    sums.sort(key=lambda r: [(s is None, s or "") for s in r["_sources"]])
    goal = targets(sizes, weights, p.share * sum(r["size"] for r in sums), p.repeats) if names else []
    flows = route([(tuple(index[s] for s in r["_sources"]), float(r["size"])) for r in sums], goal, p.repeats)
    rows = []
    for r, flow in zip(sums, flows):
        at, size = [index[s] for s in r["_sources"]], r["size"]
        amount = sum(flow.values())
        # a source with documents of its own only has one way; what was routed there is its target but for rounding
        if len(at) == 1 and shared[at[0]] == 1 and abs(amount - goal[at[0]]) <= 1e-6 * max(1.0, goal[at[0]]):
            amount = goal[at[0]]
        copies = min(p.repeats, int(amount // size)) if size else 0
        rows.append((r["_sources"], copies, float(amount - copies * size) if copies < p.repeats else 0.0,
                     sum(sizes[i] for i in at), float(sum(goal[i] for i in at))))
    plan = stage(spark.createDataFrame(rows, "_sources array<string>, base int, extra double, source_size long, target double"))

    # extra tokens in the seeded order: sums of 65,536 ranges of it, then one range exactly
    same = F.col("l._sources").eqNullSafe(F.col("r._sources"))
    part = F.substring("_u", 1, 4)
    ranges = base.groupBy("_sources", part.alias("part")).agg(F.sum("_size").alias("sum"))
    before = F.coalesce(F.sum("sum").over(W.partitionBy("_sources").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("before", before).alias("l").join(plan.alias("r"), same).select("l.*", "extra")
    edge = stage(ranges.where("before <= extra AND extra < before + sum").select("_sources", "part", "before", "extra"))
    inside = base.alias("l").join(edge.alias("r"), same & (F.substring("l._u", 1, 4) == F.col("r.part"))).select("l._sources", "part", "_u", "_size", "before", "extra")
    inside = inside.groupBy("_sources", "part", "before", "extra", "_u").agg(F.sum("_size").alias("size"))
    reach = F.col("before") + F.sum("size").over(W.partitionBy("_sources", "part").orderBy("_u"))
    last = inside.withColumn("reach", reach).where("reach - size / 2 <= extra").groupBy("_sources").agg(F.max("_u").alias("last"))
    cut = edge.alias("l").join(last.alias("r"), same, "left").select("l._sources", "part", "last")
    return stage(plan.alias("l").join(cut.alias("r"), same, "left").select("l.*", "part", "last"))


def _copies(base: DataFrame, plan: DataFrame) -> DataFrame:
    """``base`` with the columns of ``plan`` and _copies."""
    same = F.col("l._sources").eqNullSafe(F.col("r._sources"))
    early = F.substring("_u", 1, 4) < F.col("part")
    more = (F.col("extra") > 0) & (F.col("part").isNull() | early | F.coalesce(F.col("_u") <= F.col("last"), F.lit(False)))
    return base.alias("l").join(plan.alias("r"), same).select("l.*", "source_size", "target", (F.col("base") + F.when(more, 1).otherwise(0)).alias("_copies"))


def mix(docs: DataFrame, params: MixParams = MixParams(), sources: str = "source") -> DataFrame:
    """(doc_id, size, sources, copies, taken, source_size, target) per row of (doc_id, text, ``sources``).

    ``sources`` is a string or, for overlapping sources, an array of strings;
    null is a source of its own, the last, and so are null entries. size is the
    number of words, 0 for null. copies says how often the mix takes the whole
    document: all documents of a set of sources equally often, and those first
    in the seeded order (md5 of seed and doc_id) once more, up to the nearest
    document. source_size and target are the sums over the document's sources.
    Rows that repeat a doc_id share one place in the order and are taken
    together. Empty input gives no rows. Other columns are not looked at.
    """
    base = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(n) for n, c in _measured(docs, params, sources).items())))
    return _copies(base, plan_mix(base, params)).select(
        "doc_id", F.col("_size").alias("size"), F.col("_sources").alias("sources"), F.col("_copies").alias("copies"),
        (F.col("_size") * F.col("_copies")).cast("long").alias("taken"), "source_size", "target")


def mixed(docs: DataFrame, params: MixParams = MixParams(), sources: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns kept; rules as in ``mix``."""
    measured = [c.alias(n) for n, c in _measured(docs, params, sources).items()]
    plan = plan_mix(stage(docs.select(*measured)), params)
    # the row travels as one struct, so that no name inside meets a column of the documents
    taken = _copies(docs.select(F.struct(*tb.quoted(docs.columns)).alias("_row"), *measured), plan)
    return taken.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_row.*")
