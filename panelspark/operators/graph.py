"""Similarity graph between series.

Series of one country, area or package are all linked to each other. Such a
clique of n series has n * n edges, so it is kept as n memberships (node,
edge_type, group). Degrees, normalised weights, neighbours, subgraphs and
propagation follow from group sizes and group sums. Cosine edges are as many as
the square of the series, so they are not written at all: an index of the vectors
adds up what similar classes give each other, and scores the pairs asked for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.constants import MONTH, SERIES
from panelspark.functions.expr import attach, one_row, ratio
from panelspark.functions.stage import stage
from panelspark.operators import similarity

GROUP_EDGES = {
    "therapeutic": ["ther_area"],
    "same_country": ["country"],
    "same_package": ["main_package"],
    "competitive": ["country", "ther_area"],
}
DEFAULT_EDGES = ("therapeutic", "same_country", "same_package")


@dataclass
class SeriesGraph:
    """nodes(node, country, brand_name, ther_area, main_package, features), memberships(node, edge_type, group),
    the index of similar classes, classes(node, rep, copy_weight), and whether each node has a self loop of weight 1.
    Of the index only the classes named in ``classes`` count."""

    nodes: DataFrame
    memberships: DataFrame
    similar: similarity.SimilarIndex | None = None
    classes: DataFrame | None = None
    self_loops: bool = True


def first_known(column: str) -> Column:
    """First non-null value along the months of a series."""
    known = F.struct(F.col(MONTH).alias("at"), F.col(column).alias("value"))
    return F.min(F.when(F.col(column).isNotNull(), known))["value"]


def node_table(panel: DataFrame, features: list[str], normalize: bool = True) -> DataFrame:
    """One row per series: first known attributes and features, nulls as 0, features as z-scores."""
    attributes = [c for c in ("ther_area", "main_package") if c in panel.columns]
    wanted = list(dict.fromkeys([*attributes, *features]))
    nodes = panel.groupBy(*SERIES).agg(*[first_known(c).alias(c) for c in wanted])
    nodes = nodes.withColumns({f"_f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                               for i, c in enumerate(features)})
    names = [f"_f{i}" for i in range(len(features))]
    if normalize and names:
        stats = nodes.agg(*[F.struct(F.avg(n).alias("m"), (F.stddev_pop(n) + 1e-6).alias("s")).alias(n) for n in names])
        nodes = nodes.withColumn("_z", one_row(stats)).withColumns(
            {n: (F.col(n) - F.col("_z")[n]["m"]) / F.col("_z")[n]["s"] for n in names})
    vector = F.array(*[F.col(n) for n in names]) if names else F.array().cast("array<double>")
    return nodes.select(F.concat_ws("|", *SERIES).alias("node"), *SERIES, *attributes, vector.alias("features"))


def group_memberships(nodes: DataFrame, edge_types=DEFAULT_EDGES) -> DataFrame:
    """(node, edge_type, group); a node without the attribute has no such edges."""
    parts = []
    for t in edge_types:
        cols = GROUP_EDGES[t]
        here = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c) != "") for c in cols])
        parts.append(F.when(here, F.struct(F.lit(t).alias("edge_type"), F.concat_ws("|", *cols).alias("group"))))
    listed = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return nodes.select("node", F.explode(listed).alias("m")).select("node", "m.edge_type", "m.group")


def build_graph(panel: DataFrame, features: list[str], edge_types=DEFAULT_EDGES, threshold: float | None = None,
                self_loops: bool = True, normalize: bool = True) -> SeriesGraph:
    """``threshold`` adds cosine edges between series whose feature vectors are closer than it."""
    nodes = stage(node_table(panel, features, normalize))
    similar = classes = None
    if threshold is not None:
        similar, known = similarity.similar_index(nodes, "node", "features", threshold)
        classes = stage(known.withColumnRenamed("id", "node"))
    return SeriesGraph(nodes, stage(group_memberships(nodes, edge_types)), similar, classes, self_loops)


def group_sizes(graph: SeriesGraph) -> DataFrame:
    return stage(graph.memberships.groupBy("edge_type", "group").agg(F.count(F.lit(1)).alias("size")))


def edge_summary(graph: SeriesGraph) -> DataFrame:
    """Edges per type, each unordered pair once; self loops as type 'temporal'."""
    n = F.col("size")
    out = group_sizes(graph).groupBy("edge_type").agg(F.sum(n * (n - 1) / 2).cast("long").alias("n_edges"))
    if graph.similar is not None:
        size = class_sizes(graph)
        # every pair is met from both sides
        across = (_linked(graph, size, weighted=False).join(size, "rep")
                  .agg((F.coalesce(F.sum((F.col("size") * F.col("d")).cast("decimal(38,0)")), F.lit(0)) / 2).cast("long").alias("n")))
        inside = size.where("copy_weight > 0").agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0)).cast("long").alias("n"))
        out = out.unionByName(across.unionByName(inside).agg(
            F.lit("similar_erosion").alias("edge_type"), F.sum("n").alias("n_edges")))
    if graph.self_loops:
        out = out.unionByName(graph.nodes.agg(F.lit("temporal").alias("edge_type"), F.count(F.lit(1)).alias("n_edges")))
    return out


def class_sizes(graph: SeriesGraph) -> DataFrame:
    return stage(graph.classes.groupBy("rep", "copy_weight").agg(F.count(F.lit(1)).alias("size")))


def _linked(graph: SeriesGraph, size: DataFrame, weighted: bool) -> DataFrame:
    """(rep, d): the nodes of other classes that a class is similar to, each by its cosine where ``weighted``."""
    values = size.select("rep", F.array(F.col("size").cast("double")).alias("v"))
    return graph.similar.sums(values, weighted).select("rep", F.col("sums")[0].alias("d"))


def _similar_degrees(graph: SeriesGraph, weighted: bool) -> DataFrame:
    """(node, d) from cosine edges: those to other classes and those to copies."""
    size = class_sizes(graph)
    copy = F.col("copy_weight") if weighted else F.when(F.col("copy_weight") > 0, 1.0).otherwise(0.0)
    inside = size.select("rep", ((F.col("size") - 1) * copy).alias("d"))
    per_class = stage(_linked(graph, size, weighted).unionByName(inside).groupBy("rep").agg(F.sum("d").alias("d")))
    return graph.classes.select("node", "rep").join(per_class, "rep").select("node", "d")


def degrees(graph: SeriesGraph, loops: bool = True, weighted: bool = True) -> DataFrame:
    """Degree of every node (group edges weigh 1); a self loop adds 1 where asked for."""
    parts = graph.memberships.join(group_sizes(graph), ["edge_type", "group"]).select(
        "node", (F.col("size") - 1).cast("double").alias("d"))
    if graph.similar is not None:
        parts = parts.unionByName(_similar_degrees(graph, weighted))
    base = 1.0 if loops and graph.self_loops else 0.0
    zero = graph.nodes.select("node", F.lit(base).alias("d"))
    return parts.unionByName(zero).groupBy("node").agg(F.sum("d").alias("degree"))


def pair_edges(graph: SeriesGraph, pairs: DataFrame) -> DataFrame:
    """Edges that join the two nodes of each given pair (src, dst): one row per edge type with its weight."""
    a = graph.memberships.select(F.col("node").alias("src"), "edge_type", F.col("group").alias("g1"))
    b = graph.memberships.select(F.col("node").alias("dst"), "edge_type", F.col("group").alias("g2"))
    shared = (pairs.join(a, "src").join(b, ["dst", "edge_type"]).where((F.col("g1") == F.col("g2")) & (F.col("src") != F.col("dst")))
              .select("src", "dst", "edge_type", F.lit(1.0).alias("weight")))
    if graph.similar is not None:
        known = graph.classes
        placed = (pairs.where(F.col("src") != F.col("dst"))
                  .join(known.select(F.col("node").alias("src"), F.col("rep").alias("_a"), F.col("copy_weight").alias("_w")), "src")
                  .join(known.select(F.col("node").alias("dst"), F.col("rep").alias("_b")), "dst"))
        known = graph.similar.placed
        for side in ("_a", "_b"):
            placed = placed.join(known.select(F.col("rep").alias(side), F.struct("u", "norm").alias(f"{side}v")), side)
        (u1, n1), (u2, n2) = ((F.col(f"{side}v")["u"], F.col(f"{side}v")["norm"]) for side in ("_a", "_b"))
        near = placed.withColumn("weight", F.when(F.col("_a") == F.col("_b"), F.when(F.col("_w") > 0, F.col("_w"))).otherwise(
            graph.similar.similarity(u1, n1, u2, n2)))
        shared = shared.unionByName(near.where(F.col("weight").isNotNull()).select(
            "src", "dst", F.lit("similar_erosion").alias("edge_type"), "weight"))
    if graph.self_loops:
        shared = shared.unionByName(pairs.where(F.col("src") == F.col("dst")).select(
            "src", "dst", F.lit("temporal").alias("edge_type"), F.lit(1.0).alias("weight")))
    return shared


def adjacency(graph: SeriesGraph, pairs: DataFrame, normalized: bool = True) -> DataFrame:
    """Entries of the adjacency matrix for the given pairs; D^-1/2 A D^-1/2 where normalised. Missing entries are 0."""
    entries = pair_edges(graph, pairs.select("src", "dst").distinct()).groupBy("src", "dst").agg(
        F.sum("weight").alias("weight"))
    if not normalized:
        return entries
    d = stage(degrees(graph))
    root = F.sqrt(F.col("_ds") * F.col("_dd"))
    return (entries.join(d.select(F.col("node").alias("src"), F.col("degree").alias("_ds")), "src")
            .join(d.select(F.col("node").alias("dst"), F.col("degree").alias("_dd")), "dst")
            .withColumn("weight", F.coalesce(ratio(F.col("weight"), root), F.lit(0.0))).drop("_ds", "_dd"))


def centrality(graph: SeriesGraph) -> DataFrame:
    """Edge count of each node over the largest one, and over n - 1; self loops do not count."""
    counted = stage(degrees(graph, loops=False, weighted=False).withColumnRenamed("degree", "_d"))
    top = counted.agg(F.max("_d").alias("_top"), F.count(F.lit(1)).alias("_n"))
    return attach(counted, top).select(
        "node", F.coalesce(ratio(F.col("_d"), F.col("_top")), F.lit(0.0)).alias("degree"),
        F.when(F.col("_n") > 1, F.col("_d") / (F.col("_n") - 1)).otherwise(F.col("_d")).alias("degree_share"))


def neighbors(graph: SeriesGraph, node: str) -> DataFrame:
    """Distinct neighbours of one node; its own loop counts as one, as in an edge list."""
    mine = graph.memberships.where(F.col("node") == node).select("edge_type", "group")
    out = graph.memberships.join(mine, ["edge_type", "group"], "left_semi").where(F.col("node") != node).select("node")
    if graph.similar is not None:
        mine = graph.classes.where(F.col("node") == node)
        own, alike = mine.select("rep"), mine.where("copy_weight > 0").select("rep")
        vectors = graph.similar.placed
        it = one_row(vectors.join(own, "rep", "left_semi").agg(F.first("rep").alias("rep"), F.first("u").alias("u"), F.first("norm").alias("norm")))
        near = vectors.withColumn("_it", it).where((F.col("rep") != F.col("_it.rep")) & graph.similar.similarity(
            F.col("u"), F.col("norm"), F.col("_it.u"), F.col("_it.norm")).isNotNull()).select("rep")
        out = out.unionByName(graph.classes.join(near.unionByName(alike).distinct(), "rep", "left_semi")
                              .where(F.col("node") != node).select("node"))
    if graph.self_loops:
        out = out.unionByName(graph.nodes.where(F.col("node") == node).select("node"))
    return out.distinct()


def subgraph(graph: SeriesGraph, keep: DataFrame) -> SeriesGraph:
    """Induced subgraph of the nodes named in ``keep`` (column node)."""
    names = keep.select("node").distinct()

    def cut(df):
        return None if df is None else df.join(names, "node", "left_semi")

    return SeriesGraph(cut(graph.nodes), cut(graph.memberships), graph.similar, cut(graph.classes), graph.self_loops)


def filter_by(graph: SeriesGraph, column: str, value: str) -> SeriesGraph:
    """Induced subgraph of one country or therapeutic area."""
    return subgraph(graph, graph.nodes.where(F.col(column) == value))


def normalize_edges(edges: DataFrame, self_loops: bool = True) -> DataFrame:
    """Normalise an explicit edge list (src, dst, weight): w / sqrt(d(src) d(dst)) with d the row sum.

    Self loops of weight 1 are added for every node first.
    """
    rows = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    if self_loops:
        nodes = rows.select(F.col("src").alias("n")).unionByName(rows.select(F.col("dst").alias("n"))).distinct()
        rows = rows.unionByName(nodes.select(F.col("n").alias("src"), F.col("n").alias("dst"), F.lit(1.0).alias("weight")))
    d = rows.groupBy("src").agg(F.sum("weight").alias("_d"))
    root = F.sqrt(F.col("_ds") * F.coalesce("_dd", F.lit(0.0)))
    return (rows.join(d.withColumnRenamed("_d", "_ds"), "src")
            .join(d.select(F.col("src").alias("dst"), F.col("_d").alias("_dd")), "dst", "left")
            .select("src", "dst", F.coalesce(ratio(F.col("weight"), root), F.lit(0.0)).alias("weight")))


def _sum_arrays(column: str, dim: int) -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(dim)])


def propagate(graph: SeriesGraph, features: DataFrame | None = None, hops: int = 1) -> DataFrame:
    """One or more steps of normalised neighbourhood propagation of (node, features).

    For a clique the sum over the other members is the group sum minus the own
    value, so a step costs one aggregate per group and never an edge join.
    """
    current = features if features is not None else graph.nodes.select("node", "features")
    dim = similarity.width(current, "features")
    d = stage(degrees(graph)).select("node", F.coalesce(ratio(F.lit(1.0), F.sqrt("degree")), F.lit(0.0)).alias("_r"))

    def less(total: Column, own: Column) -> Column:
        return F.zip_with(total, own, lambda s, z: s - z)

    for _ in range(hops):
        z = stage(current.join(d, "node").select("node", "_r", F.transform("features", lambda x: x * F.col("_r")).alias("z")))
        inside = z.join(graph.memberships, "node")
        sums = stage(inside.groupBy("edge_type", "group").agg(_sum_arrays("z", dim).alias("_sum")))
        got = inside.join(sums, ["edge_type", "group"]).select("node", less(F.col("_sum"), F.col("z")).alias("y"))
        if graph.similar is not None:
            placed = z.join(graph.classes, "node")
            own = stage(placed.groupBy("rep").agg(_sum_arrays("z", dim).alias("_own")))
            across = stage(graph.similar.sums(own.select("rep", F.col("_own").alias("v"))).withColumnRenamed("sums", "_far"))
            copies = F.transform(less(F.col("_own"), F.col("z")), lambda x: x * F.col("copy_weight"))
            joined = placed.join(own, "rep").join(across, "rep", "left")
            got = (got.unionByName(joined.select("node", copies.alias("y")))
                   .unionByName(joined.where(F.col("_far").isNotNull()).select("node", F.col("_far").alias("y"))))
        if graph.self_loops:
            got = got.unionByName(z.select("node", F.col("z").alias("y")))
        current = stage(got.groupBy("node").agg(_sum_arrays("y", dim).alias("y")).join(z.select("node", "_r"), "node")
                        .select("node", F.transform("y", lambda x: x * F.col("_r")).alias("features")))
    return current


def readout(features: DataFrame, groups: DataFrame, pooling: str = "mean") -> DataFrame:
    """Pool node features per graph: ``groups`` maps node to graph_id."""
    agg = {"mean": F.avg, "max": F.max, "sum": F.sum}.get(pooling)
    if agg is None:
        raise ValueError(f"unknown pooling {pooling!r}")
    dim = similarity.width(features, "features")
    return features.join(groups.select("node", "graph_id"), "node").groupBy("graph_id").agg(
        F.array(*[agg(F.col("features")[i]) for i in range(dim)]).alias("features"))


def node_features(panel: DataFrame, static: list[str], aggregated: list[str], graph: SeriesGraph | None = None) -> DataFrame:
    """Standardised static columns and per-series mean and deviation; centrality where a graph is given.

    Numeric static columns are scaled by their mean and deviation over the panel
    rows, booleans become 0/1, nulls 0 before scaling.
    """
    numeric = [c for c in static if dict(panel.dtypes)[c] not in ("boolean", "string")]
    rows = panel.agg(*[F.struct(F.avg(c).alias("m"), (F.stddev_samp(c) + 1e-6).alias("s")).alias(c) for c in numeric]) \
        if numeric else None
    stats = panel.groupBy(*SERIES).agg(
        *[first_known(c).alias(c) for c in static],
        *[F.avg(c).alias(f"{c}_mean") for c in aggregated], *[F.stddev_samp(c).alias(f"{c}_std") for c in aggregated])
    stats = stats.withColumns({f"{c}_std": F.coalesce(f"{c}_std", F.lit(0.0)) for c in aggregated})
    names = [f"{c}_{k}" for c in aggregated for k in ("mean", "std")]
    out = stats
    if names:
        scale = stats.agg(*[F.struct(F.avg(n).alias("m"), (F.stddev_samp(n) + 1e-6).alias("s")).alias(n) for n in names])
        out = out.withColumn("_a", one_row(scale)).withColumns(
            {n: (F.coalesce(n, F.lit(0.0)) - F.col("_a")[n]["m"]) / F.col("_a")[n]["s"] for n in names}).drop("_a")
    if rows is not None:
        out = out.withColumn("_r", one_row(rows)).withColumns(
            {c: F.when(F.col(c).isNull(), 0.0).otherwise((F.col(c) - F.col("_r")[c]["m"]) / F.col("_r")[c]["s"])
             for c in numeric}).drop("_r")
    flags = [c for c in static if c not in numeric]
    out = out.withColumns({c: F.coalesce(F.col(c).cast("boolean").cast("double"), F.lit(0.0)) for c in flags}) if flags else out
    if graph is not None:
        c = centrality(graph)
        out = out.withColumn("node", F.concat_ws("|", *SERIES)).join(c, "node", "left").drop("node")
    return out
