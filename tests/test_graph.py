"""Golden graph cases (hand-computed / closed forms) for degree and eigenvector centrality and median delay."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlens.operators import eigen, features, graph

CASES = {
    "single": ([("1", "2")], 2, 1.0, 0.707107),
    "dup_rev": ([("1", "2"), ("2", "1"), ("1", "2")], 2, 1.0, 0.707107),
    "path": ([("1", "2"), ("1", "3")], 3, 0.666667, 0.569036),
    "triangle": ([("1", "2"), ("2", "3"), ("3", "1")], 3, 1.0, 0.577350),
    "star10": ([("0", str(i)) for i in range(1, 11)], 11, 0.181818, 0.267561),
    "selfloop": ([("1", "1")], 1, 1.0, 1.0),
    "edge_loop": ([("1", "1"), ("1", "2")], 2, 2.0, 0.688191),
}


def _edges(spark):
    rows = [(pid, s, t) for pid, (es, *_rest) in CASES.items() for s, t in es]
    return spark.createDataFrame(rows, "propagation_id string, source string, target string")


def test_degree_and_eigen_golden(spark):
    e = graph.undirected_edges(_edges(spark))
    deg = {r.propagation_id: r for r in graph.avg_degree_centrality(e).collect()}
    eig = {r.propagation_id: r for r in features.eigenvector_summary(e).collect()}
    for pid, (_, n, avg_deg, avg_eig) in CASES.items():
        assert deg[pid].n_vertices == n
        assert deg[pid].avg_degree_centrality == pytest.approx(avg_deg, abs=1e-6)
        assert eig[pid].eigenvector_centrality == pytest.approx(avg_eig, abs=1e-5)


def test_degree_per_vertex_matches_closed_form(spark):
    e = graph.undirected_edges(_edges(spark))
    per_vertex = graph.degree_centrality(e).groupBy("propagation_id").agg(F.avg("degree_centrality").alias("m"))
    closed = graph.avg_degree_centrality(e)
    for r in per_vertex.join(closed, "propagation_id").collect():
        assert r.m == pytest.approx(r.avg_degree_centrality, abs=1e-12)


def _random_edges(spark, graphs=25, seed=0):
    """Graphs of very different shape and size, self-loops, hubs and chains, with vertex names shared between graphs."""
    r = np.random.default_rng(seed)
    rows = []
    for g in range(graphs):
        n = int(r.integers(1, 40))
        rows += [(f"g{g}", f"v{a}", f"v{b}") for a, b in r.integers(0, n, (int(r.integers(1, 60)), 2))]
    rows += [("hub", "h", f"v{i}") for i in range(300)] + [("chain", f"v{i:03d}", f"v{i + 1:03d}") for i in range(60)]
    return graph.undirected_edges(spark.createDataFrame(rows, "propagation_id string, source string, target string"))


def _plain_iteration(edges, max_iter=1000, tol=1e-6):
    """The library's definition, one graph, dictionaries and lists only."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    x = {v: 1 / len(near) for v in near}
    for step in range(1, max_iter + 1):
        y = {v: x[v] + sum(x[u] for u in near[v]) for v in near}
        norm = math.sqrt(sum(z * z for z in y.values())) or 1.0
        y = {v: z / norm for v, z in y.items()}
        if sum(abs(y[v] - x[v]) for v in near) < len(near) * tol:
            return y, step
        x = y
    return None, max_iter


def _solved(df):
    return {(r.propagation_id, r.vertex): (r.eigenvector_centrality, r.iterations, r.converged) for r in df.collect()}


def test_both_paths_give_the_same_bits(spark, monkeypatch):
    # few steps: some graphs are done early, some do not converge in time
    e = graph.undirected_edges(_edges(spark)).union(_random_edges(spark, 6)).persist()
    want = _solved(eigen.eigenvector_centrality(e, max_iter=6, path="batched"))
    assert {x[2] for x in want.values()} == {True, False}
    assert want == _solved(eigen.eigenvector_centrality(e.repartition(7), max_iter=6, path="iterative"))
    monkeypatch.setattr(eigen, "BATCH_EDGES", 9)
    assert want == _solved(eigen.eigenvector_centrality(e.repartition(5), max_iter=6, path="batched"))
    monkeypatch.setattr(eigen, "BROADCAST_GRAPHS", 0)
    assert want == _solved(eigen.eigenvector_centrality(e, max_iter=6, max_edges_in_group=40))
    with pytest.raises(ValueError):
        eigen.eigenvector_centrality(e, path="other")
    e.unpersist()


@pytest.mark.parametrize("path", ["batched", "iterative"])
def test_a_graph_at_the_step_limit(spark, path):
    e = _random_edges(spark, 0).where("propagation_id = 'chain' and a < 'v003'").persist()
    tol = 0.005
    (_, steps, ok) = next(iter(_solved(eigen.eigenvector_centrality(e, tol=tol, path="batched")).values()))
    assert ok and 2 < steps < 12
    at = _solved(eigen.eigenvector_centrality(e, max_iter=steps, tol=tol, path=path))
    before = _solved(eigen.eigenvector_centrality(e, max_iter=steps - 1, tol=tol, path=path))
    assert all(x[1:] == (steps, True) and x[0] > 0 for x in at.values())
    assert all(x == (None, steps - 1, False) for x in before.values())
    assert at == _solved(eigen.eigenvector_centrality(e, max_iter=steps, tol=tol, path="batched"))
    e.unpersist()


def test_batched_path_equals_a_plain_iteration(spark):
    e = _random_edges(spark)
    got, edges = _solved(eigen.eigenvector_centrality(e)), {}
    for r in e.collect():
        edges.setdefault(r.propagation_id, []).append((r.a, r.b))
    assert len(got) == sum(len({v for x in es for v in x}) for es in edges.values())
    for g, es in edges.items():
        x, steps = _plain_iteration(es)
        for v in {v for x in es for v in x}:
            value, n, ok = got[g, v]
            assert (n, ok) == (steps, x is not None)
            assert value is None if x is None else value == pytest.approx(x[v], abs=1e-12)
    assert eigen.eigenvector_centrality(e.limit(0)).count() == 0


def test_non_convergence_gives_null(spark):
    e = graph.undirected_edges(_edges(spark)).filter("propagation_id = 'star10'")
    s = features.eigenvector_summary(e, max_iter=2).collect()[0]
    assert s.eigenvector_centrality is None and s.eig_converged is False


def test_empty_graph_keeps_row(spark):
    props = spark.createDataFrame([("p1", "t", "fake"), ("p2", "u", "real")], "propagation_id string, text string, label string")
    raw = spark.createDataFrame([("p1", "a", "b")], "propagation_id string, source string, target string")
    delays = spark.createDataFrame([], "propagation_id string, pos long, n_events long, delay double")
    out = {r.propagation_id: r for r in features.propagation_features(props, raw, delays).collect()}
    assert out["p2"].graph_status == "empty" and out["p2"].avg_degree_centrality is None
    assert out["p2"].median_retweet_time == 0.0
    assert out["p1"].graph_status == "ok"


@pytest.mark.parametrize("values,expected", [([], 0.0), ([5.0], 5.0), ([10.0, 3.0], 6.5), ([1.0, 2.0, 4.0, 10.0], 3.0)])
def test_median_from_array(spark, values, expected):
    df = spark.createDataFrame([(values,)], "d array<double>")
    assert df.select(graph.median_from_array(F.col("d"))).first()[0] == expected


def test_median_sorted_long_form(spark):
    rows = [("a", i + 1, 5, d) for i, d in enumerate([1.0, 2.0, 4.0, 10.0])] + [("b", 1, 2, 5.0)]
    df = spark.createDataFrame(rows, "propagation_id string, pos long, n_events long, delay double")
    out = {r.propagation_id: r.median_retweet_time for r in graph.median_delay_sorted(df).collect()}
    assert out == {"a": 3.0, "b": 5.0}


def test_eigen_invariances(spark):
    """Relabelling vertices and reversing / duplicating edges leave the mean centrality unchanged."""
    base = [("g", "1", "2"), ("g", "2", "3"), ("g", "3", "4"), ("g", "4", "1"), ("g", "1", "3")]
    variant = [("h", "z" + t, "z" + s) for _, s, t in base] + [("h", "z2", "z1")]
    df = spark.createDataFrame(base + variant, "propagation_id string, source string, target string")
    s = {r.propagation_id: r.eigenvector_centrality for r in features.eigenvector_summary(graph.undirected_edges(df)).collect()}
    assert s["g"] == pytest.approx(s["h"], abs=1e-12)
    assert s["g"] <= 1 / math.sqrt(4) + 1e-12


def test_hourly_graphs_that_do_not_converge(spark):
    """Hourly chain graphs of the sf0.1 events: some need more than 1,000 steps -> NULL + 'not_converged'."""
    from spreadlens.sources import fixtures

    sf = "/root/testdata/sf0.1"
    ev = fixtures.graph_events(spark, sf, "hour")
    props = fixtures.propagations(spark, sf, ev)
    f = features.propagation_features(props, fixtures.graph_edges(ev, "chain"), fixtures.graph_delays(ev))
    bad = f.filter("graph_status = 'not_converged'")
    assert bad.count() > 0
    assert bad.filter("eigenvector_centrality IS NOT NULL OR avg_degree_centrality IS NULL").count() == 0
    assert f.filter("graph_status = 'ok' AND eigenvector_centrality IS NULL").count() == 0
