"""Runner, sources, draws, factor tables and helpers: edge cases beside the queries' SQL."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from weftgraph import gas as gas_module
from weftgraph import session
from weftgraph.algorithms import analytics, cluster, graphical
from weftgraph.functions.draws import choice, draw, gamma, mixed, multinomial, normal, permutation
from weftgraph.functions.factors import SparseTable, Table
from weftgraph.functions.special import array_dot, array_scaled, array_sum, clamp, gaussian_kernel, log_gamma
from weftgraph.functions.unionfind import UnionFind
from weftgraph.gas import Aggregator, VertexProgram, load_snapshot, map_reduce_and_signal, run, signals, transform_and_signal
from weftgraph.graph import Dir, Graph
from weftgraph.operators import heavy
from weftgraph.operators.heavy import split_join
from weftgraph.sources import graphs as io


def graph(spark, edges, schema="src long, dst long", vertices=None):
    return Graph.build(spark.createDataFrame(edges, schema), vertices)


PATH = [(i, i + 1, float(i % 3 + 1)) for i in range(12)]


# -- runner ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("limit", [250_000, 2])
def test_paths_with_whole_and_with_patched_states(spark, monkeypatch, limit):
    monkeypatch.setattr(session, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(gas_module, "BROADCAST_ROWS", limit)
    g = graph(spark, [*PATH, (20, 21, 1.0)], "src long, dst long, w double")
    far = dict(rows(analytics.sssp(g, [0], weight="w").vertices, "id", "dist"))
    assert far[12] == sum(w for _, _, w in PATH) and far[3] == 6.0 and far[20] is None and far[21] is None


def test_each_vertex_has_its_own_gather_direction(spark):
    v = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0)], "id long, way int")
    g = graph(spark, [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)], vertices=v)
    state = Graph(g.vertices.withColumn("n", F.lit(-1.0)), g.edges)
    done = run(state, VertexProgram(gather_dir=F.col("c_way"), gather={"n": F.count("*")}, apply={"n": F.col("acc_n").cast("double")}), max_iterations=1)
    assert rows(done.graph.vertices, "id", "n") == [(0, 1.0), (1, 1.0), (2, 3.0), (3, 0.0)]


def test_scatter_writes_edges(spark):
    g = graph(spark, [(0, 1, 0.0), (1, 2, 0.0), (2, 0, 0.0)], "src long, dst long, w double")
    state = Graph(g.vertices.withColumn("x", F.col("id").cast("double")), g.edges)
    only = signals(state.select(F.col("id") == 1))
    program = VertexProgram(gather_dir=Dir.NONE, apply={"x": F.col("x") + 10}, scatter_dir=Dir.OUT, edge_update={"w": F.col("c_x") + F.col("n_x") + F.col("ctx_iteration")})
    done = run(state, program, messages=only)
    assert done.status == "TASK_DEPLETION" and rows(done.graph.edges, "src", "dst", "w") == [(0, 1, 0.0), (1, 2, 14.0), (2, 0, 0.0)]
    both = VertexProgram(gather_dir=Dir.NONE, apply={}, scatter_dir=Dir.ALL, edge_update={"w": F.col("w") + 1})
    assert rows(run(state, both).graph.edges, "w") == [(2.0,)] * 3


def test_a_run_goes_on_from_its_snapshot(spark, tmp_path):
    g = graph(spark, [(a, b) for a, b, _ in PATH])
    whole = rows(analytics.min_propagation(g).graph.vertices)
    state = Graph(g.vertices.select("id").withColumn("low", F.col("id").cast("double")), g.edges)
    program = VertexProgram(gather_dir=Dir.NONE, apply={"low": F.least("low", "msg")}, scatter_dir=Dir.ALL, scatter_if=F.col("c_low") < F.col("n_low"), message=F.col("c_low"), combine=F.min)
    begin = signals(state.complete_set(), F.lit(float("inf")))
    run(state, program, messages=begin, max_iterations=5, snapshot_interval=2, snapshot_path=str(tmp_path))
    vertices, messages, step = load_snapshot(spark, str(tmp_path))
    assert step == 4
    done = run(Graph(vertices, g.edges), program, messages=messages, begin_at=step)
    assert rows(done.graph.vertices) == whole and done.iterations > 8
    with pytest.raises(ValueError, match="path"):
        run(state, program, snapshot_interval=1)


def test_exceptions_timed_aggregators_and_order(spark):
    g = graph(spark, [(a, b) for a, b, _ in PATH])
    state = Graph(g.vertices.withColumn("x", F.lit(0.0)), g.edges)
    bad = VertexProgram(apply={"x": F.raise_error(F.lit("no")).cast("double")})
    done = run(state, bad, catch=True)
    assert done.status == "EXCEPTION" and "no" in str(done.error) and rows(done.graph.vertices, "x") == [(0.0,)] * 13
    with pytest.raises(Exception, match="no"):
        run(state, bad)
    count = Aggregator({"n": F.count("*")}, seconds=0.0)
    never = Aggregator({"n": F.count("*")}, seconds=1e9)
    plus = VertexProgram(apply={"x": F.col("x") + F.col("ctx_num_vertices")})
    done = run(state, plus, max_iterations=2, all_active=True, aggregators={"a": count, "b": never})
    assert done.aggregates == {"a": [{"n": 13}, {"n": 13}], "b": []} and rows(done.graph.vertices, "x") == [(26.0,)] * 13
    # Two messages a step, the greatest ids first: no state depends on it in the end.
    program = VertexProgram(gather_dir=Dir.NONE, apply={"x": F.col("x") + F.col("msg")})
    done = run(state, VertexProgram(gather_dir=Dir.NONE, apply={"x": F.col("x") + F.col("msg")}, scatter_if=F.lit(False), message=F.lit(1.0)), messages=signals(state.complete_set(), F.lit(1.0)), first=(F.desc("id"), 5))
    assert done.iterations == 3 and rows(done.graph.vertices, "x") == [(1.0,)] * 13
    assert run(state, program).iterations == 1


def test_transforms_and_map_reduce_signal(spark):
    g = graph(spark, [(1, 2), (2, 3)])
    done, messages = transform_and_signal(g, {"x": F.col("id") * 2}, F.col("x") > 2, F.col("x"))
    assert rows(done.vertices, "id", "x") == [(1, 2), (2, 4), (3, 6)] and rows(messages) == [(2, 4), (3, 6)]
    total, messages = map_reduce_and_signal(g, {"s": F.sum("id")}, F.col("id") == 3)
    assert total.first()["s"] == 6 and rows(messages) == [(3, 0.0)]


# -- sources -----------------------------------------------------------------------------------------------------------
def test_lines_of_the_callers_format(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1>2;2>3\n\n#no\nv7\n")

    def parser(file, line):
        assert file.endswith("a.txt")
        if line.startswith("v"):
            yield "v", {"id": int(line[1:])}
        elif ">" in line:
            yield from (("e", {"src": int(a), "dst": int(b)}) for a, b in (x.split(">") for x in line.split(";")))

    g = io.parse_with(spark, str(tmp_path / "a.txt"), parser)
    assert rows(g.edges) == [(1, 2), (2, 3)] and rows(g.vertices) == [(1,), (2,), (3,), (7,)]
    (tmp_path / "a.txt").write_text("1>x\n")
    with pytest.raises(Exception, match="invalid literal"):
        io.parse_with(spark, str(tmp_path / "a.txt"), parser)


def test_binary_edges_in_pieces(spark, tmp_path):
    r = random.Random(3)
    edges = [(r.randrange(50), 50 + r.randrange(50)) for _ in range(200)]
    g = graph(spark, edges, vertices=spark.createDataFrame([(500,)], "id long"))
    io.write_bintsv4(g, str(tmp_path / "b"))
    found, alone = io.read_bintsv4(spark, f"file://{tmp_path}/b", piece=64)
    assert rows(found) == sorted(edges) and rows(alone) == [(500,)]
    with pytest.raises(Exception, match="32 bits"):
        io.write_bintsv4(graph(spark, [(1, 2**33)]), str(tmp_path / "c"))


def test_line_factors(spark, tmp_path):
    (tmp_path / "f").write_text("v 1 2\nv 2 3\nd 2 9 1 2 2 3 1 1 1 10 10 100\nu 8 1 2 0.1 1\n")
    variables, factors = io.read_line_factors(spark, str(tmp_path / "f"))
    assert rows(variables) == [(1, [0.0, 0.0]), (2, [0.0, 0.0, 0.0])]
    assert rows(factors) == [(8, [1], [2], [-1.0, 0.0]), (9, [1, 2], [2, 3], [0.0, 0.0, 0.0, 1.0, 1.0, 2.0])]


def test_places_without_one_task(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x long").repartition(5)
    got = io.numbered(df, "x", "n").collect()
    assert sorted((r["x"], r["n"]) for r in got) == [(i, i + 1) for i in range(101)]


# -- joins, draws, functions -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_joins_are_joins(spark, monkeypatch, how):
    monkeypatch.setattr(heavy, "BROADCAST_ROWS", 3)
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2, 3, 4, 5, None, 9])], "k long, i int")
    right = spark.createDataFrame([(k, f"r{k}") for k in (1, 2, 3, 4, 8)], "k long, x string")
    side = right.select("k") if how in ("left_semi", "left_anti") else right
    want = sorted(map(str, left.join(side, "k", how).collect()))
    assert sorted(map(str, split_join(left, side, "k", 5, [1, 9], how).collect())) == want
    assert sorted(map(str, split_join(left, side, "k", 5, [], how).collect())) == want


def test_draws(spark):
    df = spark.range(4000).select("id", draw(F.col("id"), 1).alias("u"), normal(F.col("id"), 2).alias("z"), gamma(F.col("id"), 3.0, 4).alias("g"), multinomial(F.col("id"), F.array(F.lit(1.0), F.lit(0.0), F.lit(1.0)), 5).alias("m"), permutation(F.lit(4), F.col("id")).alias("p"), choice(F.col("id"), ["a", "b"]).alias("c"), mixed(F.lit(-5).cast("long")).alias("x"))
    p = df.toPandas()
    assert 0 < p.u.min() and p.u.max() < 1 and abs(p.u.mean() - 0.5) < 0.02 and abs(p.z.mean()) < 0.06 and abs(p.z.std() - 1) < 0.05
    assert abs(p.g.mean() - 3) < 0.15 and abs(p.g.var() - 3) < 0.5 and set(p.m) == {0, 2} and all(sorted(x) == [0, 1, 2, 3] for x in p.p) and set(p.c) == {"a", "b"}
    assert df.exceptAll(df).isEmpty() and spark.range(1).select(multinomial(F.col("id"), F.array(F.lit(0.0))).alias("m"), permutation(F.lit(0), F.col("id")).alias("p")).first() == (None, [])


def test_special_functions(spark):
    xs = [0.1, 0.5, 1.0, 2.0, 3.7, 10.0, 1234.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(log_gamma(F.col("x"))).collect()]
    assert np.allclose(got, [math.lgamma(x) for x in xs], atol=1e-9)
    r = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], -1.0)], "a array<double>, b array<double>, x double")
    assert r.select(array_sum("a", "b"), array_scaled("a", F.lit(2.0)), array_dot("a", "b"), clamp(F.col("x"), 0.0, 1.0), gaussian_kernel(F.lit(2.0), 1.0), log_gamma(F.col("x"))).first() == ([4.0, 6.0], [2.0, 4.0], 11.0, 0.0, math.exp(-1), None)


def test_union_find():
    u = UnionFind([(1, 2), (3, 4), (2, 3), ("a", "b")])
    assert u.same(1, 4) and not u.same(1, "a") and u.size(4) == 4 and u.count() == 2 and u.find(9) == 9 and u.count() == 3


def test_sparse_factor_tables_agree_with_dense_ones():
    rng = np.random.default_rng(0)

    def table(scope, shape):
        t = rng.normal(size=shape)
        t[rng.random(shape) < 0.4] = -np.inf
        t.flat[0] = 0.0
        return Table(scope, t)

    a, b = table((1, 2), (2, 3)), table((2, 3), (3, 2))
    sa, sb = SparseTable.of(a), SparseTable.of(b)
    same = lambda x, y: np.array_equal(np.isfinite(x.logp), np.isfinite(y.logp)) and np.allclose(np.exp(x.logp), np.exp(y.logp))
    assert same((sa * sb).dense(), a * b) and same(sa.dense(), a)
    assert same((sa * sb / sb).dense(), (sa * sb).marginalize((1, 2, 3)).dense()._with(Table((2, 3), np.where(np.isfinite(b.logp), -b.logp, 0)), np.add))
    assert same(sa.normalize().dense(), a.normalize()) and same(sa.condition({2: 0}).dense(), a.condition({2: 0}))
    with np.errstate(divide="ignore"):
        assert same(sa.marginalize((1,)).dense(), a.marginalize((1,))) and same(sa.marginalize((2,), True).dense(), a.marginalize((2,), True))
    assert a.logp[sa.best()] == a.logp.max()


# -- algorithms --------------------------------------------------------------------------------------------------------
def test_components_without_broadcasts(spark, monkeypatch):
    for module in (session, heavy, analytics):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 5)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)]
    found = dict(rows(analytics.connected_components(graph(spark, edges)).vertices, "id", "component"))
    assert all(found[i] == 0 for i in range(60)) and all(found[100 + i] == 100 for i in range(41))


def test_colours_are_whole_and_proper(spark):
    r = random.Random(8)
    g = graph(spark, [(a, b) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(150)) if a != b])
    near = {v: 0 for v, in rows(g.vertices, "id")}
    for a, b in rows(g.undirected()):
        near[a] += 1
        near[b] += 1
    for order in ("hash", "degree", "saturation"):
        done = analytics.color(g, order)
        colours = dict(rows(done.vertices, "id", "color"))
        assert all(0 <= colours[v] <= near[v] for v in near) and analytics.color_conflicts(done).first()["n_conflicts"] == 0
    with pytest.raises(RuntimeError, match="without a colour"):
        analytics.color(g, max_rounds=1)
    blank = Graph(g.vertices.withColumn("color", F.lit(None).cast("int")), g.edges)
    assert analytics.color_conflicts(blank).first()["n_conflicts"] == g.num_edges()


def test_nearest_similarities_are_kept_by_block(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, point array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {tuple(sorted((i, int(j)))) for i in range(60) for j in np.argsort(d[i])[:4]}
    assert set(rows(cluster.similarity_graph(df, 1.0, 4), "i", "j")) == want


def test_quadratic_subproblems_approach_the_optimum_of_a_tree(spark):
    rng = np.random.default_rng(2)
    unary, edges = rng.normal(size=(6, 2)), [(0, 1), (1, 2), (1, 3), (3, 4), (4, 5)]
    tables = {e: rng.normal(size=(2, 2)) for e in edges}
    u = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(unary)], "id long, theta array<double>")
    p = spark.createDataFrame([(k, a, b, [float(x) for x in tables[a, b].ravel()]) for k, (a, b) in enumerate(edges)], "eid long, i long, j long, theta array<double>")
    worth = lambda s: sum(unary[i][s[i]] for i in range(6)) + sum(tables[a, b][s[a], s[b]] for a, b in edges)
    best = max(worth([(k >> i) & 1 for i in range(6)]) for k in range(64))
    labels, duals, primals = graphical.alternating_decomposition(u, p, 12)
    # Twelve rounds come within a hundredth; the bound from above holds from the first.
    assert min(duals) >= best - 1e-6 and min(duals) == pytest.approx(best, rel=0.01) and max(primals) == pytest.approx(best, rel=0.01)
    assert worth([s for _, s in rows(labels, "id", "map_state")]) == pytest.approx(max(primals), abs=1e-6)
