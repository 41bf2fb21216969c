import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import graph as O
from panelspark.operators import similarity as Z


def vectors(spark, n=60, dim=5, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    rows = [(i, [float(x) for x in base[i % (n - copies) if copies else i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, v array<double>"), {i: np.array(v) for i, v in rows}


def cosine(a, b):
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-6))


@pytest.mark.parametrize("threshold,copies,chunk", [(0.5, 0, 2048), (0.8, 20, 7), (0.2, 10, 5)])
def test_similar_pairs_equal_brute_force(spark, monkeypatch, threshold, copies, chunk):
    monkeypatch.setattr(Z, "CHUNK", chunk)
    df, truth = vectors(spark, copies=copies)
    df = df.unionByName(spark.createDataFrame([(999, [0.0] * 5)], df.schema))
    pairs, classes = Z.similar_pairs(df, "id", "v", threshold)
    members: dict = {}
    for r in classes.collect():
        members.setdefault(r["rep"], []).append(r["id"])
    got = {}
    for r in pairs.collect():
        for a in members[r["src"]]:
            for b in members[r["dst"]]:
                key = (min(a, b), max(a, b))
                assert key not in got
                got[key] = r["weight"]
    for ids in members.values():
        got |= {(min(a, b), max(a, b)): 1.0 for a in ids for b in ids if a < b}
    want = {(i, j): cosine(truth[i], truth[j]) for i in truth for j in truth if i < j and cosine(truth[i], truth[j]) > threshold}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_copies_are_one_class(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(500)], "id bigint, v array<double>")
    pairs, classes = Z.similar_pairs(df, "id", "v", 0.8)
    assert pairs.count() == 0 and classes.select("rep").distinct().count() == 1 and classes.count() == 500


@pytest.mark.parametrize("dim,k,chunk,copies", [(3, 4, 2048, 0), (6, 5, 6, 20), (2, 70, 9, 0)])
def test_nearest_equals_brute_force(spark, monkeypatch, dim, k, chunk, copies):
    monkeypatch.setattr(Z, "CHUNK", chunk)
    base, truth = vectors(spark, 60, dim, 2, copies)
    asks, want_for = vectors(spark, 15, dim, 3)
    asks = asks.unionByName(spark.createDataFrame([(77, [0.0] * dim)], asks.schema))
    want_for[77] = np.zeros(dim)
    got: dict = {}
    for r in Z.nearest(asks, base, "id", "v", k).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbour"], r["distance"]))
    for q, v in want_for.items():
        n = np.linalg.norm(v)
        dist = sorted((round(1 - float((v / n if n else v) @ (t / np.linalg.norm(t))), 9), i) for i, t in truth.items())
        mine = sorted(got[q])
        assert len(mine) == min(k, 60)
        assert np.allclose([m[2] for m in mine], [x[0] for x in dist[:k]], atol=2e-9)
        if not copies and n:
            assert [m[1] for m in mine] == [x[1] for x in dist[:k]]


@pytest.fixture(scope="module")
def graph(spark):
    """20 series of 4 countries, 3 areas and 2 packages; series 0 to 4 share one feature vector."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(20):
        f = (1.0, 2.0, 3.0) if i < 5 else tuple(float(x) for x in rng.normal(size=3))
        rows.append((f"C{i % 4}", f"B{i}", 0, f"T{i % 3}", None if i == 7 else f"P{i % 2}", *f))
    df = spark.createDataFrame(rows, "country string, brand_name string, months_postgx int, ther_area string, "
                                     "main_package string, a double, b double, c double")
    return O.build_graph(df, ["a", "b", "c"], threshold=0.6)


def brute(graph):
    nodes = [r.asDict() for r in graph.nodes.orderBy("node").collect()]
    n = len(nodes)
    A, K = np.eye(n), np.zeros((n, n))
    for i, x in enumerate(nodes):
        for j, y in enumerate(nodes):
            if i == j:
                continue
            for c in ("ther_area", "country", "main_package"):
                if x[c] and x[c] == y[c]:
                    A[i, j] += 1
                    K[i, j] += 1
            s = cosine(np.array(x["features"]), np.array(y["features"]))
            if s > 0.6:
                A[i, j] += s
                K[i, j] += 1
    return [x["node"] for x in nodes], A, K, np.array([x["features"] for x in nodes])


def test_degrees_centrality_and_edges(graph):
    names, A, K, _ = brute(graph)
    d = {r["node"]: r["degree"] for r in O.degrees(graph).collect()}
    assert np.allclose([d[x] for x in names], A.sum(1), atol=1e-6)
    c = {r["node"]: r for r in O.centrality(graph).collect()}
    assert np.allclose([c[x]["degree"] for x in names], K.sum(1) / K.sum(1).max())
    total = sum(r["n_edges"] for r in O.edge_summary(graph).where("edge_type <> 'temporal'").collect())
    assert total == K.sum() / 2


def test_adjacency_and_neighbours(graph):
    names, A, K, _ = brute(graph)
    pairs = graph.nodes.sparkSession.createDataFrame([(x, y) for x in names for y in names], "src string, dst string")
    d = A.sum(1)
    got = {(r["src"], r["dst"]): r["weight"] for r in O.adjacency(graph, pairs).collect()}
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            assert got.get((x, y), 0.0) == pytest.approx(A[i, j] / np.sqrt(d[i] * d[j]), abs=1e-6)
    mine = {r["node"] for r in O.neighbors(graph, names[2]).collect()}
    assert mine == {names[j] for j in range(len(names)) if A[2, j] > 0}


def test_propagation_equals_the_matrix(graph):
    names, A, _, X = brute(graph)
    r = 1 / np.sqrt(A.sum(1))
    S = A * np.outer(r, r)
    got = {x["node"]: x["features"] for x in O.propagate(graph, hops=2).collect()}
    assert np.allclose([got[x] for x in names], S @ S @ X, atol=1e-6)


def test_subgraph_counts_only_inner_edges(graph):
    sub = O.filter_by(graph, "country", "C1")
    assert sub.nodes.count() == 5
    _, _, K, _ = brute(sub)
    total = sum(r["n_edges"] for r in O.edge_summary(sub).where("edge_type <> 'temporal'").collect())
    assert total == K.sum() / 2


def test_edge_list_normalisation(spark):
    e = spark.createDataFrame([("a", "b", 2.0), ("b", "a", 2.0)], "src string, dst string, weight double")
    got = {(r["src"], r["dst"]): r["weight"] for r in O.normalize_edges(e).collect()}
    assert got == {("a", "b"): pytest.approx(2 / 3), ("b", "a"): pytest.approx(2 / 3), ("a", "a"): pytest.approx(1 / 3), ("b", "b"): pytest.approx(1 / 3)}


def test_readout_rejects_unknown_pooling(graph):
    groups = graph.nodes.select("node", F.col("country").alias("graph_id"))
    assert O.readout(graph.nodes, groups, "sum").count() == 4
    with pytest.raises(ValueError):
        O.readout(graph.nodes, groups, "median")


def series_vectors(spark, n, seed=9):
    """Vectors as series give them: a few dimensions that vary much and more that hardly do."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) * np.array([3.0, 2.0, 1.0, 0.6, 0.3, 0.1])
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")


def test_share_of_pairs_scored_falls_with_scale(spark):
    shares = []
    for n in (150, 3000):
        pairs, _, work = Z.similar_pairs(series_vectors(spark, n), "id", "v", 0.95, report=True)
        row, found = work.first(), pairs.count()
        assert row["classes"] == n and found <= row["scored"] <= row["met"]
        shares.append(row["scored"] / (n * (n - 1) / 2))
    assert shares[1] < shares[0] and shares[1] < 0.25


def test_share_of_rows_searched_falls_with_scale(spark):
    shares = []
    for n in (600, 12_000):
        found, work = Z.nearest(series_vectors(spark, 100, 4), series_vectors(spark, n), "id", "v", 5, report=True)
        row = work.first()
        assert found.count() == 500 and row["pairs"] == 100 * n
        shares.append(row["scored"] / row["pairs"])
    assert shares[1] < shares[0] and shares[1] < 0.1


def test_nearest_without_base_or_with_zero_vectors_only(spark):
    base, _ = vectors(spark, 5, 3)
    empty = base.where("id < 0")
    assert Z.nearest(base, empty, "id", "v", 2).count() == 0
    zeros = spark.createDataFrame([(i, [0.0, 0.0, 0.0]) for i in range(4)], base.schema)
    got = sorted(tuple(r) for r in Z.nearest(base, zeros, "id", "v", 2).collect())
    assert got == sorted((q, n, 1.0, n + 1) for q in range(5) for n in range(2))
