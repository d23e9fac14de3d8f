"""Graph verbs, vertex sets, programs and analytics on small graphs with known results."""

import itertools
import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from weftgraph.algorithms import analytics, centrality
from weftgraph.gas import Aggregator, VertexProgram, run, signals
from weftgraph.graph import Dir, Graph
from weftgraph.sources import graphs as io

PARSER = [(0, 5), (1, 0), (1, 5), (2, 0), (2, 5), (3, 0), (3, 5)]
TOY = [(1, 2), (2, 3), (4, 5), (4, 6), (5, 6)]


def graph(spark, edges, schema="src long, dst long", vertices=None):
    return Graph.build(spark.createDataFrame(edges, schema), vertices)


def random_edges(n, m, seed):
    r = random.Random(seed)
    return [(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b]


def test_build_drops_loops_and_bad_ids(spark):
    v = spark.createDataFrame([(1, "x"), (9, "y"), (1, None), (-1, "z"), (None, "z")], "id long, name string")
    g = graph(spark, [(1, 2), (3, 3), (-1, 2), (None, 4), (1, 2)], vertices=v)
    assert rows(g.edges) == [(1, 2), (1, 2)]
    assert sorted(map(tuple, g.vertices.select("id", "name").collect())) == [(1, "x"), (2, None), (9, "y")] or {r["id"] for r in g.vertices.collect()} == {1, 2, 9}


def test_degrees_and_sets(spark):
    g = graph(spark, PARSER)
    assert (g.num_vertices(), g.num_edges()) == (5, 7)
    assert rows(g.degrees()) == [(0, 3, 1), (1, 0, 2), (2, 0, 2), (3, 0, 2), (5, 4, 0)]
    even, low = g.select(F.col("id") % 2 == 0), g.select(F.col("id") < 2)
    ids = lambda s: [r[0] for r in rows(s.frame())]
    assert ids(even & low) == [0] and ids(even | low) == [0, 1, 2] and ids(even - low) == [2] and ids(~even) == [1, 3, 5]
    assert ids(g.complete_set() & low) == [0, 1] and (g.empty_set()).is_empty() and (~g.complete_set()).size() == 0
    assert ids(g.neighbors(low, Dir.OUT)) == [0, 5] and ids(g.neighbors(low, Dir.IN)) == [1, 2, 3] and g.neighbors(g.complete_set(), Dir.ALL).size() == 5


def test_reciprocal_neighbours_are_met_twice(spark):
    g = graph(spark, [(1, 2), (1, 5), (7, 5), (5, 7), (7, 1)])
    count = g.aggregate_neighbors(Dir.ALL, {"n": F.count("*"), "d": F.countDistinct("nbr")})
    assert rows(count) == [(1, 3, 3), (2, 1, 1), (5, 3, 2), (7, 3, 2)]
    assert g.map_reduce_edges({"n": F.count("*")}, direction=Dir.ALL).first()[0] == 10
    assert g.map_reduce_vertices({"n": F.sum("id")}, g.empty_set()).first()[0] == 0


def test_transforms_and_joins(spark):
    v = spark.createDataFrame([(i, float(i)) for i in (0, 1, 2, 3, 5)], "id long, x double")
    g = graph(spark, [(a, b, 1.0) for a, b in PARSER], "src long, dst long, w double", v)
    h = g.transform_vertices({"x": F.col("x") * 10}, g.select(F.col("id") > 1))
    assert rows(h.vertices, "id", "x") == [(0, 0.0), (1, 1.0), (2, 20.0), (3, 30.0), (5, 50.0)]
    e = g.transform_edges({"w": F.lit(9.0)}, g.select(F.col("id") == 0), Dir.IN)
    assert rows(e.edges.filter("w = 9"), "src", "dst") == [(1, 0), (2, 0), (3, 0)]
    other = Graph(spark.createDataFrame([(1, 7.0), (-1, 8.0), (3, 9.0)], "id long, x double"), g.edges)
    joined = g.left_injective_join(other, F.col("id"), F.col("id"), {"x": F.col("r_x")})
    assert rows(joined.vertices, "id", "x") == [(0, 0.0), (1, 7.0), (2, 2.0), (3, 9.0), (5, 5.0)]
    twice = Graph(spark.createDataFrame([(1, 7.0), (1, 9.0)], "id long, x double"), g.edges)
    with pytest.raises(Exception, match="repeated"):
        g.left_injective_join(twice, F.col("id"), F.col("id"), {"x": F.col("r_x")}).vertices.collect()
    back = g.right_injective_join(other, F.col("id"), F.col("id"), {"x": F.col("r_x")})
    assert rows(back.vertices, "id", "x") == [(-1, 8.0), (1, 1.0), (3, 3.0)]


@pytest.mark.parametrize("direction,expected", [(Dir.IN, "in_degree"), (Dir.OUT, "out_degree"), (Dir.ALL, None)])
def test_gather_counts_degrees(spark, direction, expected):
    g = graph(spark, random_edges(30, 120, 1))
    state = Graph(g.vertices.withColumn("n", F.lit(-1.0)), g.edges)
    done = run(state, VertexProgram(gather_dir=direction, gather={"n": F.count("*")}, apply={"n": F.col("acc_n").cast("double")}), max_iterations=1)
    degree = F.col(expected) if expected else F.col("in_degree") + F.col("out_degree")
    assert rows(done.graph.vertices, "id", "n") == rows(g.degrees().select("id", degree.cast("double").alias("n")))
    assert done.updates == g.num_vertices()


def test_messages_stop_reasons_and_aggregators(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3)])
    state = Graph(g.vertices.withColumn("hop", F.lit(None).cast("double")), g.edges)
    program = VertexProgram(gather_dir=Dir.NONE, apply={"hop": F.col("msg")}, scatter_if=F.lit(True), message=F.col("c_hop") + 1)
    first = signals(state.select(F.col("id") == 0))
    done = run(state, program, first, aggregators={"seen": Aggregator({"n": F.count("hop")}, finalize=lambda r: r["n"])})
    assert done.status == "TASK_DEPLETION" and done.iterations == 4 and done.aggregates["seen"] == [1, 2, 3, 4]
    assert rows(done.graph.vertices, "id", "hop") == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 3.0)]
    assert run(state, program, first, max_iterations=2).status == "MAX_ITERATIONS"
    assert run(state, program, first, stop=lambda k, _: k == 1).status == "FORCED_ABORT"
    assert run(state, program, first, timeout=-1).status == "TIMEOUT"


def test_pagerank_ways_agree(spark):
    edges = random_edges(40, 200, 2)
    g = graph(spark, edges)
    out, ids = {}, {i for e in edges for i in e}
    for a, _ in edges:
        out[a] = out.get(a, 0) + 1
    rank = dict.fromkeys(ids, 1.0)
    for _ in range(60):
        new = dict.fromkeys(ids, 0.15)
        for a, b in edges:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    swept = dict(rows(analytics.pagerank(g, iterations=12).vertices, "id", "rank"))
    dynamic = dict(rows(analytics.pagerank(g, tol=1e-4).vertices, "id", "rank"))
    for i in ids:
        assert swept[i] == pytest.approx(rank[i], abs=0.2) and dynamic[i] == pytest.approx(rank[i], abs=0.01)


def test_paths_components_and_sizes(spark):
    g = graph(spark, TOY)
    assert rows(analytics.connected_components(g).vertices, "id", "component") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)]
    assert rows(analytics.component_sizes(analytics.connected_components(g).vertices)) == [(3, 2)]
    assert rows(analytics.min_propagation(g).graph.vertices, "id", "low") == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 4.0), (5, 4.0), (6, 4.0)]
    assert rows(analytics.sssp(g, [1], directed=True).vertices.filter("dist IS NOT NULL"), "id", "dist") == [(1, 0.0), (2, 1.0), (3, 2.0)]
    assert analytics.max_degree_vertex(g) == 2
    chain = graph(spark, [(i, i + 1) for i in range(300)])
    assert analytics.connected_components(chain).vertices.select("component").distinct().count() == 1


def test_cores_triangles_colours(spark):
    edges = list({(min(e), max(e)) for e in random_edges(25, 150, 3)})
    g = graph(spark, edges)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {v: sum(1 for a, b in itertools.combinations(near[v], 2) if b in near[a]) for v in near}
    assert dict(rows(analytics.triangle_counts(g))) == want
    core = dict(near)
    while weak := [v for v in core if len(core[v] & core.keys()) < 8]:
        for v in weak:
            del core[v]
    left = rows(analytics.kcore(g, 8))
    assert {v for e in left for v in e} == set(core)
    for order in ("hash", "degree", "saturation"):
        coloured = analytics.color(g, order)
        colours = dict(rows(coloured.vertices, "id", "color"))
        assert all(colours[a] != colours[b] for a, b in edges) and max(colours.values()) <= max(len(n) for n in near.values())


def test_directed_triangles(spark):
    g = graph(spark, [(1, 2), (2, 3), (3, 1), (1, 3), (1, 2)])
    got = {r["id"]: r.asDict() for r in analytics.directed_triangle_counts(g).collect()}
    assert sum(r["cycle_triangles"] for r in got.values()) == 3 and sum(r["out_triangles"] for r in got.values()) == 1
    assert got[3]["in_triangles"] == 1 and got[1]["out_triangles"] == 1 and got[1]["through_triangles"] == 1 and got[1]["out_degree"] == 2


def test_spectra(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3)]
    g = graph(spark, edges)
    a = np.zeros((4, 4))
    for i, j in edges:
        a[i, j] = a[j, i] = 1
    values, vectors = np.linalg.eigh(a)
    want = vectors @ np.diag(np.exp(values)) @ vectors.T @ np.ones(4)
    got = dict(rows(analytics.total_subgraph_centrality(g), "id", "tsc"))
    assert [got[i] for i in range(4)] == pytest.approx(list(want), rel=1e-8)
    assert np.allclose(analytics.matrix_exp(a), vectors @ np.diag(np.exp(values)) @ vectors.T)
    lap = {(i, j): v for i, j, v in rows(analytics.laplacian(g))}
    assert lap[0, 1] == pytest.approx(0.5) and lap[3, 3] == 2.0
    hops, counts = analytics.approximate_diameter(graph(spark, [(i, i + 1) for i in range(5)]), exact=True)
    assert counts[-1] == 21 and hops == 5
    assert analytics.approximate_diameter(graph(spark, [(0, 1), (1, 2)]), exact=True)[0] == 2


def test_topology_labels_cascade(spark):
    levels, acyclic = analytics.topological_levels(graph(spark, PARSER))
    assert acyclic and dict(rows(levels, "id", "level")) == {1: 0, 2: 0, 3: 0, 0: 1, 5: 2}
    assert not analytics.topological_levels(graph(spark, [(0, 1), (1, 2), (2, 1)]))[1]
    v = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b"), (5, "a"), (6, None)], "id long, label string")
    got = analytics.label_propagation(graph(spark, [(3, 1), (3, 2), (6, 4), (6, 5), (6, 1)], vertices=v), max_iterations=1)
    assert dict(rows(got.vertices.filter("id in (3, 6)"), "id", "label")) == {3: "a", 6: "b"}
    s = spark.createDataFrame([(i, "I" if i == 0 else "S") for i in range(20)], "id long, status string")
    star = graph(spark, [(0, i) for i in range(1, 20)], vertices=s)
    assert rows(analytics.cascade(star, infect=1.0, recover=0.0, steps=1).vertices.filter("status = 'I'"), "id") == [(i,) for i in range(20)]


def test_centrality_against_brute_force(spark):
    edges = list(set(random_edges(12, 40, 5)))
    g = graph(spark, edges)
    ids = sorted({i for e in edges for i in e})
    dist = {}
    for s in ids:
        d, front = {s: 0}, [s]
        while front:
            front = list(dict.fromkeys(b for a in front for x, b in edges if x == a and b not in d))
            for b in front:
                d[b] = min(d[a] for a, x in edges if x == b and a in d) + 1
        dist[s] = d
    roots = g.vertices.select(F.col("id").alias("root"))
    got = {(a, b): x for a, b, x in rows(centrality.dijkstra_forest(g, roots), "root", "id", "dist")}
    assert got == {(a, b): float(x) for a in ids for b, x in dist[a].items()}

    def paths(s, t):
        return 1 if s == t else sum(paths(s, a) for a, b in edges if b == t and a in dist[s] and dist[s][a] + 1 == dist[s][t])

    want = dict.fromkeys(ids, 0.0)
    for s, t in itertools.permutations(ids, 2):
        if t in dist[s]:
            for v in ids:
                if v not in (s, t) and v in dist[s] and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]:
                    want[v] += paths(s, v) * paths(v, t) / paths(s, t)
    between = dict(rows(centrality.betweenness(g, roots)))
    assert all(between[v] == pytest.approx(want[v]) for v in ids)
    near = dict((i, m) for i, _, m in rows(centrality.closeness(g, roots), "id", "n_roots", "mean_dist"))
    for v in near:
        others = [dist[v][t] for t in ids if t != v and t in dist[v]]
        assert near[v] == pytest.approx(sum(others) / len(others))


@pytest.mark.parametrize("fmt", ["snap", "tsv", "csv", "adj", "bintsv4", "bin", "journal"])
def test_files_round_trip(spark, tmp_path, fmt):
    g = graph(spark, PARSER)
    path = str(tmp_path / fmt)
    io.save_graph(g, path, fmt)
    back = io.load_graph(spark, path, fmt)
    assert rows(back.edges, "src", "dst") == PARSER and rows(back.vertices, "id") == rows(g.vertices, "id")
    io.convert(spark, path, fmt, str(tmp_path / "other"), "tsv")
    assert rows(io.load_graph(spark, str(tmp_path / "other"), "tsv").edges, "src", "dst") == PARSER


def test_parsers(spark, tmp_path):
    (tmp_path / "a.adj").write_text("1 2 3 4\n\n2 0\n5 1 6\n")
    g = io.load_graph(spark, str(tmp_path / "a.adj"), "adj")
    assert rows(g.edges) == [(1, 3), (1, 4), (5, 6)] and (2,) in rows(g.vertices)
    (tmp_path / "b.adj").write_text("1 3 3 4\n7 1 8\n")
    with pytest.raises(Exception, match="adj"):
        io.load_graph(spark, str(tmp_path / "b.adj"), "adj").edges.collect()
    assert rows(io.load_graph(spark, str(tmp_path / "b.adj"), "adj", "drop").edges) == [(7, 8)]
    (tmp_path / "c.snap").write_text("# head\n1 2\n3 3\n")
    assert rows(io.load_graph(spark, str(tmp_path / "c.snap"), "snap").edges) == [(1, 2)]
    (tmp_path / "r.validate").write_text("1 2 5.0\n3 7 2.5 0.5\n")
    assert sorted(map(tuple, io.read_ratings(spark, str(tmp_path / "r.validate"), weighted=True).collect())) == [(1, 2, 5.0, 1.0, "validate"), (3, 7, 2.5, 0.5, "validate")]
    (tmp_path / "l").write_text("1 red 2 3\n2 blue\n")
    lab = io.read_labelled_adjacency(spark, str(tmp_path / "l"))
    assert rows(lab.edges) == [(1, 2), (1, 3)] and dict(rows(lab.vertices.filter("label is not null"), "id", "label")) == {1: "red", 2: "blue"}
    (tmp_path / "w").write_text("1 2 0.5 3 1.5\n4\n")
    assert rows(io.read_weighted_adjacency(spark, str(tmp_path / "w")).edges) == [(1, 2, 0.5), (1, 3, 1.5)]
    (tmp_path / "p").write_text("0:1.5 2:2\n1:3\n")
    assert sorted(r["point"] for r in io.read_points(spark, str(tmp_path / "p"), sparse=True).collect()) == [[0.0, 3.0, 0.0], [1.5, 0.0, 2.0]]
    (tmp_path / "m.uai").write_text("MARKOV 2 2 2 1 2 0 1 4 1 2 3 4")
    v, f = io.read_markov(spark, str(tmp_path / "m.uai"))
    assert v.count() == 2 and f.first()["scope"] == [0, 1] and f.first()["logp"][3] == pytest.approx(math.log(4))
    (tmp_path / "k").write_text("1 1:1 9:1\n-1 9:1\n")
    assert rows(io.read_clicks(spark, str(tmp_path / "k")), "label", "feature") == [(-1, 9), (1, 1), (1, 9)]


def test_writers_and_powerlaw(spark):
    g = graph(spark, [(10, 20), (20, 30), (30, 20)])
    assert [v for _, v in rows(io.metis_lines(g))] == ["3 2", "2", "1 3", "2"]
    assert rows(io.hypergraph_lines(g)) == [("10 1 1",), ("20 2 1 2",), ("30 1 2",)]
    p = io.powerlaw(spark, 1000)
    assert p.num_vertices() == 1000 and p.edges.filter("src = dst").isEmpty() and p.num_edges() >= 1000
    assert rows(p.edges) == rows(io.powerlaw(spark, 1000).edges)
    assert io.powerlaw(spark, 1).num_edges() == 0


def test_empty_graph(spark):
    g = graph(spark, [])
    assert g.num_vertices() == 0 and rows(analytics.pagerank(g, iterations=2).vertices) == [] and rows(analytics.connected_components(g).vertices) == []
    assert rows(analytics.triangle_counts(g)) == [] and rows(analytics.kcore(g, 2)) == []


def test_powerlaw_beyond_its_table(spark, monkeypatch):
    before, far = rows(io.powerlaw(spark, 3000, 1.3).edges), [rows(io.powerlaw(spark, 3000, a).edges.groupBy("src").count()) for a in (1.0, 1.3)]
    monkeypatch.setattr(io, "POWERLAW_TABLE", 100)
    assert rows(io.powerlaw(spark, 3000, 1.3).edges) == before
    assert [rows(io.powerlaw(spark, 3000, a).edges.groupBy("src").count()) for a in (1.0, 1.3)] == far and max(d for _, d in far[0]) > 2000
    assert list(io._power_sum(1_000_001, np.array([1_000_000, 3_000_000]), 2.1)) == pytest.approx([0, float((np.arange(1_000_001, 3_000_001) ** -2.1).sum())], rel=1e-9)


def test_powerlaw_has_degrees_beyond_a_million(spark):
    g = io.powerlaw(spark, 4_000_000, 1.01)
    assert g.edges.filter("src < 30").groupBy("src").count().agg(F.max("count")).first()[0] > 1_000_000
