"""Queries over graphs made from the tables: verbs, vertex sets, joins, aggregates and graph analytics, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.algorithms import analytics, centrality
from weftgraph.functions.draws import draw, sql_draw, sql_mixed
from weftgraph.functions.vertexkey import coded, sql_code
from weftgraph.gas import Aggregator, VertexProgram, run, signals
from weftgraph.graph import Dir, Graph, VertexSet
from weftgraph.operators.neighborhood import broadcast_neighborhood, top_k, transform_neighborhood
from weftgraph.plans.tables import table
from weftgraph.session import written
from weftgraph.sources.graphs import LAST_STEP, metis_lines, parse_edges, save_graph, load_graph, powerlaw
from weftgraph.session import scratch_path
from weftgraph.streaming.incremental import event_windows, merge_components

#: Added to the ids of the second kind of vertex, so that no two kinds share an id.
OFFSET = 10_000_000_000


# -- graphs ------------------------------------------------------------------------------------------------------------
def customer_supplier(spark: SparkSession, d: str) -> Graph:
    """Customers and the suppliers they bought from; the customers carry their market segment and balance."""
    pairs = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = pairs.select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + OFFSET).alias("dst")).distinct()
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("balance"))
    return Graph.build(edges, customers)


def consecutive_customers(spark: SparkSession, d: str) -> Graph:
    """Customers of consecutive orders, with the first order's number and a weight of 1 to 7."""
    a = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("src"))
    b = table(spark, d, "orders").select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("dst"))
    edges = a.join(b, "o_orderkey").select("src", "dst", (F.pmod("o_orderkey", F.lit(7)) + 1).cast("double").alias("weight"), "o_orderkey")
    return Graph.build(edges)


def place_tree(spark: SparkSession, d: str) -> Graph:
    """Customers and suppliers point to their nation, nations to their region."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_nationkey") + 2 * OFFSET).alias("dst"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + OFFSET).alias("src"), (F.col("s_nationkey") + 2 * OFFSET).alias("dst"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 2 * OFFSET).alias("src"), (F.col("n_regionkey") + 3 * OFFSET).alias("dst"))
    return Graph.build(c.unionByName(s).unionByName(n))


def match_graph(spark: SparkSession, d: str) -> Graph:
    """Vertex keys as numbers, linked where a row of test_tsv names both: hubs, long chains, many small components."""
    return Graph.build(coded(table(spark, d, "test_tsv"), {"src": F.col("c0"), "dst": F.col("c1")}))


BIP = f"edges AS (SELECT DISTINCT o_custkey AS src, l_suppkey + {OFFSET} AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey), ids AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges UNION SELECT c_custkey FROM customer)"
CONSEC = "edges AS MATERIALIZED (SELECT a.o_custkey AS src, b.o_custkey AS dst, (a.o_orderkey % 7 + 1)::DOUBLE AS weight, a.o_orderkey FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_custkey <> b.o_custkey), ids AS MATERIALIZED (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"
TREE = f"edges AS MATERIALIZED (SELECT c_custkey AS src, (c_nationkey + {2 * OFFSET})::BIGINT AS dst FROM customer UNION ALL SELECT s_suppkey + {OFFSET}, s_nationkey + {2 * OFFSET} FROM supplier UNION ALL SELECT n_nationkey + {2 * OFFSET}, n_regionkey + {3 * OFFSET} FROM nation), ids AS MATERIALIZED (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"
MATCH = f"edges AS MATERIALIZED (SELECT src, dst FROM (SELECT {sql_code('c0')} AS src, {sql_code('c1')} AS dst FROM test_tsv) WHERE src <> dst), ids AS MATERIALIZED (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"
NEAR = "near AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges)"
PAIRS = "pairs AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges)"
SEGMENTS = "AUTOMOBILE BUILDING FURNITURE HOUSEHOLD MACHINERY".split()

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


# -- sizes, sets, maps -------------------------------------------------------------------------------------------------
@query(f"WITH {BIP} SELECT id, (SELECT count(*) FROM edges WHERE dst = id) AS in_degree, (SELECT count(*) FROM edges WHERE src = id) AS out_degree FROM ids")
def g_degrees(spark: SparkSession, d: str) -> DataFrame:
    return customer_supplier(spark, d).degrees()


@query(f"WITH {BIP} SELECT (SELECT count(*) FROM ids) AS n_vertices, (SELECT count(*) FROM edges) AS n_edges")
def g_sizes(spark: SparkSession, d: str) -> DataFrame:
    g = customer_supplier(spark, d)
    return g.vertices.agg(F.count("*").alias("n_vertices")).crossJoin(F.broadcast(g.edges.agg(F.count("*").alias("n_edges"))))


_SETS = f"WITH {BIP}, poor AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0), auto AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = '{SEGMENTS[0]}')"


@query(
    _SETS
    + """ SELECT 'and' AS op, count(*) AS n FROM (SELECT * FROM poor INTERSECT SELECT * FROM auto)
UNION ALL SELECT 'or', count(*) FROM (SELECT * FROM poor UNION SELECT * FROM auto)
UNION ALL SELECT 'minus', count(*) FROM (SELECT * FROM poor EXCEPT SELECT * FROM auto)
UNION ALL SELECT 'not', count(*) FROM (SELECT * FROM ids EXCEPT SELECT * FROM poor)
UNION ALL SELECT 'all', count(*) FROM ids UNION ALL SELECT 'none', 0
UNION ALL SELECT 'out', count(DISTINCT dst) FROM edges WHERE src IN (SELECT id FROM poor)
UNION ALL SELECT 'in', count(DISTINCT src) FROM edges WHERE dst IN (SELECT id FROM poor)"""
)
def g_vertex_sets(spark: SparkSession, d: str) -> DataFrame:
    g = customer_supplier(spark, d)
    poor, auto = g.select(F.col("balance") < 0), g.select(F.col("label") == SEGMENTS[0])
    named = {"and": poor & auto, "or": poor | auto, "minus": poor - auto, "not": ~poor, "all": g.complete_set(), "none": g.empty_set(), "out": g.neighbors(poor, Dir.OUT), "in": g.neighbors(poor, Dir.IN)}
    out = None
    for name, s in named.items():
        row = s.frame().agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {BIP} SELECT i.id, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS balance FROM ids i LEFT JOIN customer ON c_custkey = i.id")
def g_transform_vertices(spark: SparkSession, d: str) -> DataFrame:
    g = customer_supplier(spark, d)
    return g.transform_vertices({"balance": F.lit(0.0)}, g.select(F.col("balance") < 0)).vertices.select("id", "balance")


@query(f"WITH {CONSEC} SELECT src, dst, o_orderkey, CASE WHEN src < dst THEN weight * 2 ELSE weight END AS weight FROM edges")
def g_transform_edges(spark: SparkSession, d: str) -> DataFrame:
    g = consecutive_customers(spark, d)
    marked = Graph(g.vertices.withColumn("rank", F.col("id")), g.edges)
    doubled = F.when(F.col("s_rank") < F.col("t_rank"), F.col("weight") * 2).otherwise(F.col("weight"))
    return transform_neighborhood(marked, Dir.OUT, {"weight": doubled}).edges.select("src", "dst", "o_orderkey", "weight")


@query(f"WITH {CONSEC} SELECT sum(weight) AS total_in, 2 * sum(weight) AS total_all, max(weight) AS heaviest, count(*) AS n_in FROM edges")
def g_map_reduce_edges(spark: SparkSession, d: str) -> DataFrame:
    g = consecutive_customers(spark, d)
    one = g.map_reduce_edges({"total_in": F.sum("weight"), "heaviest": F.max("weight"), "n_in": F.count("*")}, direction=Dir.IN)
    return one.crossJoin(F.broadcast(g.map_reduce_edges({"total_all": F.sum("weight")}, direction=Dir.ALL)))


@query("SELECT count(c_acctbal) AS n, round(sum(c_acctbal), 2) AS total, min(c_acctbal) AS least, max(c_acctbal) AS most, (SELECT min(c_custkey) FROM customer WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer)) AS richest FROM customer")
def g_map_reduce_vertices(spark: SparkSession, d: str) -> DataFrame:
    g = customer_supplier(spark, d)
    total = F.round(F.sum("balance"), 2)
    out = g.map_reduce_vertices({"n": F.count("balance"), "total": total, "least": F.min("balance"), "most": F.max("balance"), "richest": F.max_by("id", F.struct("balance", (-F.col("id")).alias("i")))}, default=0)
    return out



def _counted(batches: Iterator[pd.DataFrame], value: str) -> Iterator[pd.DataFrame]:
    for b in batches:
        x = b[value].dropna()
        yield pd.DataFrame({"n": [len(x)], "n_positive": [int((x > 0).sum())], "most": [float(x.max()) if len(x) else float("-inf")]})


def _folded() -> dict:
    return {"n": F.sum("n"), "n_positive": F.sum("n_positive"), "most": F.max("most")}


@query("SELECT count(c_acctbal) AS n, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END)::BIGINT AS n_positive, max(c_acctbal) AS most FROM customer")
def g_fold_vertices(spark: SparkSession, d: str) -> DataFrame:
    """A fold by batches, one partial row per batch."""
    return customer_supplier(spark, d).fold_vertices(lambda batches: _counted(batches, "balance"), "n long, n_positive long, most double", _folded())


@query(f"WITH {CONSEC} SELECT count(*) AS n, count(*) AS n_positive, max(weight) AS most FROM edges WHERE dst IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def g_fold_edges(spark: SparkSession, d: str) -> DataFrame:
    """A fold over the edges that arrive at customers who owe money."""
    g = consecutive_customers(spark, d)
    poor = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return g.fold_edges(lambda batches: _counted(batches, "weight"), "n long, n_positive long, most double", _folded(), VertexSet(g, poor))


@query(f"WITH {BIP} SELECT s_suppkey + {OFFSET} AS id, s_acctbal + coalesce(n, 0) AS balance FROM supplier LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) ON dst = s_suppkey + {OFFSET}")
def g_right_injective_join(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers, updated by the number of their customers in the other graph."""
    g = customer_supplier(spark, d)
    left = Graph(g.degrees(), g.edges)
    right = Graph(table(spark, d, "supplier").select((F.col("s_suppkey") + OFFSET).alias("id"), F.col("s_acctbal").alias("balance")), g.edges)
    return left.right_injective_join(right, F.col("id"), F.col("id"), {"balance": F.col("balance") + F.col("r_in_degree")}).vertices.select("id", "balance")


@query(f"WITH {BIP} SELECT dst AS id, count(*) AS n_buyers, round(avg(c_acctbal), 6) AS mean_balance FROM edges JOIN customer ON src = c_custkey GROUP BY dst")
def g_aggregate_neighbors(spark: SparkSession, d: str) -> DataFrame:
    g = customer_supplier(spark, d)
    return g.aggregate_neighbors(Dir.IN, {"n_buyers": F.count("n_balance"), "mean_balance": F.round(F.avg("n_balance"), 6)}, nbr=["balance"])


@query(f"WITH {BIP}, t AS (SELECT dst, sum(c_acctbal) AS s FROM edges JOIN customer ON src = c_custkey GROUP BY dst) SELECT id, round(coalesce(s, 0), 4) AS income FROM ids LEFT JOIN t ON dst = id")
def g_gather_apply(spark: SparkSession, d: str) -> DataFrame:
    g = customer_supplier(spark, d)
    return g.gather_apply(Dir.IN, {"s": F.sum("n_balance")}, {"income": F.round("s", 4)}, nbr=["balance"]).vertices.select("id", "income")


@query(f"WITH {BIP} SELECT dst AS id, max(c_acctbal) AS msg FROM edges JOIN customer ON src = c_custkey WHERE c_acctbal > 0 GROUP BY dst")
def g_broadcast_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    g = customer_supplier(spark, d)
    return broadcast_neighborhood(g, Dir.OUT, F.col("c_balance"), F.max, center=["balance"], when=F.col("c_balance") > 0)


@query(f"WITH {BIP} SELECT i.id, coalesce(s_acctbal, c_acctbal) AS balance FROM ids i LEFT JOIN customer ON c_custkey = i.id LEFT JOIN supplier ON s_suppkey + {OFFSET} = i.id")
def g_injective_join(spark: SparkSession, d: str) -> DataFrame:
    g = customer_supplier(spark, d)
    other = Graph(table(spark, d, "supplier").select((F.col("s_suppkey") + OFFSET).alias("id"), F.col("s_acctbal").alias("balance")), g.edges)
    return g.left_injective_join(other, F.col("id"), F.col("id"), {"balance": F.col("r_balance")}).vertices.select("id", "balance")


@query("SELECT n_name, place, c_custkey, c_acctbal FROM (SELECT n_name, c_custkey, c_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE place <= 3")
def g_top_k(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return top_k(rows, ["n_name"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("n_name", F.col("place").cast("long").alias("place"), "c_custkey", "c_acctbal")


@query(f"WITH {CONSEC}, {NEAR} SELECT a AS id, count(DISTINCT b) AS n_neighbors, list_sort(list(DISTINCT b)) AS neighbors FROM near GROUP BY a")
def g_neighbor_lists(spark: SparkSession, d: str) -> DataFrame:
    return consecutive_customers(spark, d).neighbor_lists()


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def g_sample_sort(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


# -- programs ----------------------------------------------------------------------------------------------------------
def _pagerank_sql(source: str, n: int) -> str:
    steps = ["r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM ids)", "deg AS MATERIALIZED (SELECT src, count(*) AS d FROM edges GROUP BY src)"]
    for k in range(1, n + 1):
        steps.append(f"r{k} AS MATERIALIZED (SELECT i.id, 0.15 + 0.85 * coalesce(s, 0) AS rank FROM ids i LEFT JOIN (SELECT dst, sum(rank / d) AS s FROM edges JOIN deg USING (src) JOIN r{k - 1} ON id = src GROUP BY dst) ON dst = i.id)")
    return f"WITH {source}, {', '.join(steps)} SELECT id, round(rank, 6) AS rank FROM r{n}"


@query(_pagerank_sql(BIP, 3))
def g_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return analytics.pagerank(customer_supplier(spark, d), iterations=3).vertices.select("id", F.round("rank", 6).alias("rank"))


@query(_pagerank_sql(CONSEC, 3))
def g_pagerank_program(spark: SparkSession, d: str) -> DataFrame:
    """The same as a vertex program with all vertices active, and an aggregator beside it."""
    g = consecutive_customers(spark, d)
    degree = g.degrees().select("id", "out_degree")
    state = Graph(g.vertices.join(degree, "id").withColumn("rank", F.lit(1.0)), g.edges)
    program = VertexProgram(gather={"r": F.sum(F.col("n_rank") / F.col("n_out_degree"))}, apply={"rank": 0.15 + 0.85 * F.col("acc_r")})
    done = run(state, program, max_iterations=3, all_active=True, aggregators={"total": Aggregator({"total": F.sum("rank")})})
    return done.graph.vertices.select("id", F.round("rank", 6).alias("rank"))


def _dynamic_sql(n: int, start: float, tol: float, per_edge: bool) -> str:
    """Supersteps with active vertices; once nothing is active the state stays."""
    steps = [f"deg AS MATERIALIZED (SELECT src, count(*) AS d FROM edges GROUP BY src), r0 AS MATERIALIZED (SELECT id, {start}::DOUBLE AS rank, NULL::DOUBLE AS old, TRUE AS was FROM ids), a0 AS MATERIALIZED (SELECT id FROM ids)"]
    for k in range(1, n + 1):
        steps.append(
            f"s{k} AS MATERIALIZED (SELECT dst, sum(rank / d) AS s FROM edges JOIN deg USING (src) JOIN r{k - 1} ON id = src WHERE dst IN (SELECT id FROM a{k - 1}) GROUP BY dst), "
            f"r{k} AS MATERIALIZED (SELECT x.id, CASE WHEN a.id IS NULL THEN x.rank ELSE 0.15 + 0.85 * coalesce(s, 0) END AS rank, x.rank AS old, a.id IS NOT NULL AS was FROM r{k - 1} x LEFT JOIN a{k - 1} a USING (id) LEFT JOIN s{k} ON dst = x.id), "
            f"a{k} AS MATERIALIZED (SELECT DISTINCT dst AS id FROM edges JOIN deg USING (src) JOIN r{k} ON id = src WHERE was AND abs(rank - old){' / d' if per_edge else ''} > {tol})"
        )
    return f"WITH {CONSEC}, {', '.join(steps)} SELECT id, round(rank, 5) AS rank FROM r{n}"


@query(_dynamic_sql(20, 1.0, 0.01, False))
def g_pagerank_dynamic(spark: SparkSession, d: str) -> DataFrame:
    return analytics.pagerank(consecutive_customers(spark, d), tol=1e-2, max_iterations=20).vertices.select("id", F.round("rank", 5).alias("rank"))


@query(_dynamic_sql(20, 0.15, 0.001, True))
def g_extension_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return analytics.extension_pagerank(consecutive_customers(spark, d), tol=1e-3, max_iterations=20).vertices.select("id", F.round("rank", 5).alias("rank"))


@query(f"WITH {CONSEC}, {NEAR} SELECT a AS id, count(*)::DOUBLE AS n_received FROM near GROUP BY a")
def g_signal_all(spark: SparkSession, d: str) -> DataFrame:
    """Every vertex signals all around it once; messages are summed on arrival."""
    g = consecutive_customers(spark, d)
    state = Graph(g.vertices.withColumn("n_received", F.lit(0.0)), g.edges)
    program = VertexProgram(gather_dir=Dir.NONE, apply={"n_received": F.col("msg")}, scatter_dir=Dir.ALL, scatter_if=F.col("c_n_received") == 0, message=F.lit(1.0))
    return run(state, program, messages=signals(state.complete_set()), max_iterations=2).graph.vertices


def _bellman_sql(weight: str, rounds: int) -> str:
    steps = ["d0 AS (SELECT id, CASE WHEN id = (SELECT min(id) FROM ids) THEN 0.0::DOUBLE END AS dist FROM ids)", f"hops AS MATERIALIZED (SELECT src AS a, dst AS b, min({weight}) AS w FROM edges GROUP BY 1, 2 UNION ALL SELECT dst, src, min({weight}) FROM edges GROUP BY 1, 2)"]
    for k in range(1, rounds + 1):
        steps.append(f"d{k} AS MATERIALIZED (SELECT x.id, least(x.dist, m) AS dist FROM d{k - 1} x LEFT JOIN (SELECT b, min(dist + w) AS m FROM hops JOIN d{k - 1} ON id = a GROUP BY b) ON b = x.id)")
    return f"WITH {CONSEC}, {', '.join(steps)} SELECT id, dist FROM d{rounds}"


@query(_bellman_sql("1.0", 10))
def g_sssp(spark: SparkSession, d: str) -> DataFrame:
    g = consecutive_customers(spark, d)
    root = g.vertices.agg(F.min("id")).first()[0]
    return analytics.sssp(g, [root]).vertices.select("id", "dist")


@query(_bellman_sql("weight", 16))
def g_sssp_weighted(spark: SparkSession, d: str) -> DataFrame:
    g = consecutive_customers(spark, d)
    root = g.vertices.agg(F.min("id")).first()[0]
    return analytics.sssp(g, [root], weight="weight").vertices.select("id", "dist")


def components_sql(source: str, rounds: int, tail: str) -> str:
    """Minimum labels with hooking and jumping, unrolled; ``tail`` selects from ``final`` (id, component)."""
    steps = ["c0 AS (SELECT id, id AS l FROM ids)"]
    for k in range(1, rounds + 1):
        steps.append(
            f"n{k} AS MATERIALIZED (SELECT x.id, x.l, least(x.l, coalesce(m, x.l)) AS n FROM c{k - 1} x LEFT JOIN (SELECT a, min(l) AS m FROM near JOIN c{k - 1} ON id = b GROUP BY a) ON a = x.id), "
            f"h{k} AS MATERIALIZED (SELECT l AS h, min(n) AS hn FROM n{k} WHERE n < l GROUP BY l), "
            f"j{k} AS MATERIALIZED (SELECT id, least(n, coalesce(hn, n)) AS n FROM n{k} LEFT JOIN h{k} ON h = id), "
            f"c{k} AS MATERIALIZED (SELECT x.id, least(x.n, coalesce(y.n, x.n)) AS l FROM j{k} x LEFT JOIN j{k} y ON y.id = x.n)"
        )
    return f"WITH {source}, {NEAR}, {', '.join(steps)}, final AS (SELECT id, l AS component FROM c{rounds}) {tail}"


ROUNDS = 16


@query(components_sql(MATCH, ROUNDS, "SELECT id, component FROM final"))
def g_components(spark: SparkSession, d: str) -> DataFrame:
    return analytics.connected_components(match_graph(spark, d)).vertices.select("id", "component")


@query(components_sql(MATCH, ROUNDS, "SELECT size, count(*) AS n_components FROM (SELECT count(*) AS size FROM final GROUP BY component) GROUP BY size"))
def g_component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return analytics.component_sizes(analytics.connected_components(match_graph(spark, d)).vertices)


@query(components_sql(MATCH, ROUNDS, ", e AS (SELECT DISTINCT src, dst FROM edges), f AS (SELECT component, min((src, dst)) AS m FROM e JOIN final ON id = src GROUP BY 1) SELECT src, dst, m[1] AS component_src, m[2] AS component_dst FROM e JOIN final ON id = src JOIN f USING (component)"))
def g_bond_percolation(spark: SparkSession, d: str) -> DataFrame:
    return analytics.bond_percolation(match_graph(spark, d))


@query(f"WITH {CONSEC} SELECT id AS id, (SELECT min(id) FROM ids)::DOUBLE AS low FROM ids")
def g_min_propagation(spark: SparkSession, d: str) -> DataFrame:
    return analytics.min_propagation(consecutive_customers(spark, d)).graph.vertices.select("id", "low")


def _kcore_sql(ks: range, rounds: int) -> str:
    steps, outs, before = [], [], "edges"
    for k in ks:
        prev = before
        for r in range(rounds):
            name = f"k{k}_{r}"
            steps.append(f"{name} AS MATERIALIZED (SELECT src, dst FROM {prev} WHERE src IN (SELECT v FROM (SELECT src AS v FROM {prev} UNION ALL SELECT dst FROM {prev}) GROUP BY v HAVING count(*) >= {k}) AND dst IN (SELECT v FROM (SELECT src AS v FROM {prev} UNION ALL SELECT dst FROM {prev}) GROUP BY v HAVING count(*) >= {k}))")
            prev = name
        before = prev
        outs.append(f"SELECT {k} AS k, (SELECT count(*) FROM (SELECT src FROM {prev} UNION SELECT dst FROM {prev})) AS n_vertices, (SELECT count(*) FROM {prev}) AS n_edges")
    return f"WITH {CONSEC}, {', '.join(steps)} {' UNION ALL '.join(outs)}"


@query(_kcore_sql(range(8, 11), 8))
def g_kcore(spark: SparkSession, d: str) -> DataFrame:
    return analytics.kcore_sizes(consecutive_customers(spark, d), 8, 10)


@query(f"WITH {CONSEC}, {PAIRS} SELECT count(*) AS n_triangles FROM pairs x JOIN pairs y ON y.a = x.b JOIN pairs z ON z.a = x.a AND z.b = y.b")
def g_triangles(spark: SparkSession, d: str) -> DataFrame:
    return analytics.triangles(consecutive_customers(spark, d)).agg(F.count("*").alias("n_triangles"))


@query(f"WITH {CONSEC}, {PAIRS}, t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM pairs x JOIN pairs y ON y.a = x.b JOIN pairs z ON z.a = x.a AND z.b = y.b), v AS (SELECT p AS id FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) SELECT ids.id, count(v.id) AS n_triangles FROM ids LEFT JOIN v ON v.id = ids.id GROUP BY ids.id")
def g_triangle_counts(spark: SparkSession, d: str) -> DataFrame:
    return analytics.triangle_counts(consecutive_customers(spark, d))


@query(
    f"""WITH {CONSEC}, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges),
i AS (SELECT x.dst AS id, count(*) AS n FROM e x JOIN e y ON y.dst = x.src JOIN e z ON z.src = y.src AND z.dst = x.dst GROUP BY 1),
o AS (SELECT x.src AS id, count(*) AS n FROM e x JOIN e y ON y.src = x.src JOIN e z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1),
t AS (SELECT x.src AS id, count(*) AS n FROM e x JOIN e y ON y.src = x.src JOIN e z ON z.src = y.dst AND z.dst = x.dst GROUP BY 1),
c AS (SELECT x.src AS id, count(*) AS n FROM e x JOIN e y ON y.dst = x.src JOIN e z ON z.src = x.dst AND z.dst = y.src GROUP BY 1)
SELECT ids.id, coalesce(i.n, 0) AS in_triangles, coalesce(o.n, 0) AS out_triangles, coalesce(t.n, 0) AS through_triangles, coalesce(c.n, 0) AS cycle_triangles,
(SELECT count(*) FROM e WHERE dst = ids.id) AS in_degree, (SELECT count(*) FROM e WHERE src = ids.id) AS out_degree
FROM ids LEFT JOIN i ON i.id = ids.id LEFT JOIN o ON o.id = ids.id LEFT JOIN t ON t.id = ids.id LEFT JOIN c ON c.id = ids.id"""
)
def g_directed_triangles(spark: SparkSession, d: str) -> DataFrame:
    return analytics.directed_triangle_counts(consecutive_customers(spark, d))


def _color_sql(order: str, rounds: int) -> str:
    first = {"hash": "0.0", "degree": "(SELECT count(*) FROM edges WHERE src = ids.id)", "saturation": "(SELECT count(*) FROM nb WHERE a = ids.id)"}[order]
    steps = [f"{PAIRS}, nb AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), s0 AS MATERIALIZED (SELECT id, ({first})::DOUBLE AS p, {sql_draw('id', 0)} AS h, NULL::BIGINT AS color FROM ids)"]
    for k in range(1, rounds + 1):
        p = "CASE WHEN a.id IS NULL THEN p ELSE len(used) END" if order == "saturation" else "p"
        steps.append(
            f"a{k} AS MATERIALIZED (SELECT m.id, bool_or(t.color IS NULL AND (t.p > m.p OR (t.p = m.p AND (t.h > m.h OR (t.h = m.h AND t.id > m.id))))) AS later, coalesce(list(DISTINCT t.color) FILTER (t.color IS NOT NULL), []) AS used FROM s{k - 1} m JOIN nb ON a = m.id JOIN s{k - 1} t ON t.id = b WHERE m.color IS NULL GROUP BY m.id), "
            f"s{k} AS MATERIALIZED (SELECT s.id, {p} AS p, h, CASE WHEN color IS NOT NULL THEN color WHEN NOT later THEN list_min(list_filter(range(0, len(used) + 1), lambda c: NOT list_contains(used, c))) END AS color FROM s{k - 1} s LEFT JOIN a{k} a ON a.id = s.id)"
        )
    return f"WITH {CONSEC}, {', '.join(steps)} SELECT id, color FROM s{rounds}"


def _colored(spark: SparkSession, d: str, order: str) -> DataFrame:
    return analytics.color(consecutive_customers(spark, d), order).vertices.select("id", F.col("color").cast("long").alias("color"))


@query(_color_sql("hash", 60))
def g_coloring(spark: SparkSession, d: str) -> DataFrame:
    return _colored(spark, d, "hash")


@query(_color_sql("degree", 60))
def g_coloring_by_degree(spark: SparkSession, d: str) -> DataFrame:
    return _colored(spark, d, "degree")


@query(_color_sql("saturation", 90))
def g_coloring_by_saturation(spark: SparkSession, d: str) -> DataFrame:
    return _colored(spark, d, "saturation")


def _hops(spark: SparkSession, found: tuple[int, list[float]]) -> DataFrame:
    return spark.createDataFrame([(hop, n, found[0]) for hop, n in enumerate(found[1])], "hop int, pairs double, diameter int")


@query(f"WITH {TREE}, one AS (SELECT DISTINCT src, dst FROM edges), two AS (SELECT DISTINCT a.src, b.dst FROM one a JOIN one b ON b.src = a.dst), n AS (SELECT (SELECT count(*) FROM ids) AS n0, (SELECT count(*) FROM one) AS n1, (SELECT count(*) FROM two) AS n2) SELECT h AS hop, (n0 + CASE WHEN h > 0 THEN n1 ELSE 0 END + CASE WHEN h > 1 THEN n2 ELSE 0 END)::DOUBLE AS pairs, 2 AS diameter FROM n, range(4) t(h)")
def g_diameter_exact(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within reach by hop, and the diameter: the last hop that adds pairs."""
    return _hops(spark, analytics.approximate_diameter(place_tree(spark, d), exact=True))


def _sketch_sql(masks: int, hops: int, tol: float) -> str:
    names = [f"m{i}" for i in range(masks)]
    bits = ", ".join(f"(1::BIGINT << least(61, floor(-log2({sql_draw('id', 0, i)}))::INT)) AS m{i}" for i in range(masks))
    steps = [f"e AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges), k0 AS MATERIALIZED (SELECT id, {bits} FROM ids)"]
    ones = " + ".join(f"(bit_count(xor({m}, {m} + 1)) - 1)" for m in names)
    for k in range(1, hops + 1):
        steps.append(f"k{k} AS MATERIALIZED (SELECT id, {', '.join(f'bit_or({m}) AS {m}' for m in names)} FROM (SELECT * FROM k{k - 1} UNION ALL SELECT src, {', '.join(names)} FROM e JOIN k{k - 1} ON id = dst) GROUP BY id)")
    counts = " UNION ALL ".join(f"SELECT {k} AS hop, sum(floor(pow(2.0, ({ones}) / {masks}.0) / {analytics.FM_CONSTANT})) AS pairs FROM k{k}" for k in range(hops + 1))
    return f"WITH {CONSEC}, {', '.join(steps)}, c AS MATERIALIZED ({counts}), g AS (SELECT *, pairs < lag(pairs) OVER (ORDER BY hop) * (1 + {tol}) AS still FROM c), f AS (SELECT min(hop) AS stop FROM g WHERE still) SELECT hop, pairs, stop - 1 AS diameter FROM c, f WHERE hop <= stop"


@query(_sketch_sql(10, 12, 1e-4))
def g_diameter_sketched(spark: SparkSession, d: str) -> DataFrame:
    return _hops(spark, analytics.approximate_diameter(consecutive_customers(spark, d)))


_LAPLACE = f"WITH {CONSEC}, w AS MATERIALIZED (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS w FROM edges GROUP BY 1, 2), s AS MATERIALIZED (SELECT a AS i, b AS j, w FROM w UNION ALL SELECT b, a, w FROM w), deg AS MATERIALIZED (SELECT i, sum(w) AS d FROM s GROUP BY i)"


@query(f"{_LAPLACE} SELECT s.i, s.j, round(w / sqrt(x.d * y.d), 6) AS v FROM s JOIN deg x ON x.i = s.i JOIN deg y ON y.i = s.j UNION ALL SELECT i, i, 2.0 FROM deg")
def g_laplacian(spark: SparkSession, d: str) -> DataFrame:
    return analytics.laplacian(consecutive_customers(spark, d), "weight").select("i", "j", F.round("v", 6).alias("v"))


@query(f"{_LAPLACE} SELECT i, j, -w AS v FROM s UNION ALL SELECT i, i, d FROM deg")
def g_laplacian_ratio(spark: SparkSession, d: str) -> DataFrame:
    return analytics.laplacian(consecutive_customers(spark, d), "weight", "ratio")


def _labels_sql(rounds: int) -> str:
    steps = ["l0 AS (SELECT i.id, c_mktsegment AS label FROM ids i LEFT JOIN customer ON c_custkey = i.id)"]
    for k in range(1, rounds + 1):
        steps.append(f"n{k} AS MATERIALIZED (SELECT a, label, count(*) AS n FROM near JOIN l{k - 1} ON id = b WHERE label IS NOT NULL GROUP BY 1, 2), l{k} AS MATERIALIZED (SELECT x.id, coalesce(b.label, x.label) AS label FROM l{k - 1} x LEFT JOIN (SELECT a, label FROM (SELECT a, label, row_number() OVER (PARTITION BY a ORDER BY n DESC, label) AS p FROM n{k}) WHERE p = 1) b ON b.a = x.id)")
    return f"WITH {BIP.replace('AS (SELECT', 'AS MATERIALIZED (SELECT')}, {NEAR}, {', '.join(steps)} SELECT id, label FROM l{rounds}"


@query(_labels_sql(3))
def g_label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return analytics.label_propagation(customer_supplier(spark, d), max_iterations=3).vertices.select("id", "label")


def _cascade_sql(steps: int) -> str:
    out = ["s0 AS MATERIALIZED (SELECT i.id, CASE WHEN c_acctbal < 0 THEN 'I' ELSE 'S' END AS s FROM ids i LEFT JOIN customer ON c_custkey = i.id)"]
    for k in range(steps):
        u = sql_draw("x.id", k, 0)
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT x.id, CASE WHEN s = 'I' AND {u} < 0.2 THEN 'R' WHEN s = 'S' AND {u} < 1 - pow(0.7, coalesce(n, 0)) THEN 'I' ELSE s END AS s FROM s{k} x LEFT JOIN (SELECT a, count(*) AS n FROM near JOIN s{k} ON id = b WHERE s = 'I' GROUP BY a) ON a = x.id)")
    return f"WITH {BIP.replace('AS (SELECT', 'AS MATERIALIZED (SELECT')}, {NEAR}, {', '.join(out)} SELECT id, s AS status FROM s{steps}"


@query(_cascade_sql(4))
def g_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Whoever owes money is infected at the start."""
    g = customer_supplier(spark, d)
    state = Graph(g.vertices.select("id", F.when(F.col("balance") < 0, "I").otherwise("S").alias("status")), g.edges)
    return analytics.cascade(state, steps=4).vertices


@query(f"WITH {TREE} SELECT id, CASE WHEN id >= {3 * OFFSET} THEN 2 WHEN id >= {2 * OFFSET} THEN 1 ELSE 0 END AS level FROM ids")
def g_topological_levels(spark: SparkSession, d: str) -> DataFrame:
    return analytics.topological_levels(place_tree(spark, d))[0].select("id", "level")


def _exp_sql(terms: int) -> str:
    steps = [f"{PAIRS}, nb AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), t0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS x FROM ids)"]
    for k in range(1, terms + 1):
        steps.append(f"t{k} AS MATERIALIZED (SELECT a AS id, sum(x) / {k} AS x FROM nb JOIN t{k - 1} ON id = b GROUP BY a)")
    every = " UNION ALL ".join(f"SELECT id, x FROM t{k}" for k in range(terms + 1))
    return f"WITH {CONSEC}, {', '.join(steps)} SELECT id, round(ln(sum(x)), 6) AS log_tsc FROM ({every}) GROUP BY id"


@query(_exp_sql(90))
def g_subgraph_centrality(spark: SparkSession, d: str) -> DataFrame:
    """The logarithm of exp(A) 1, whose series the SQL sums."""
    return analytics.total_subgraph_centrality(consecutive_customers(spark, d)).select("id", F.round(F.log("tsc"), 6).alias("log_tsc"))


# -- centrality from sampled roots on the graph of consecutive customers -----------------------------------------------
SAMPLED = 12


def _far_sql(rounds: int, weight: str, reverse: bool) -> str:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = [f"hops AS MATERIALIZED (SELECT {a} AS a, {b} AS b, min({weight})::DOUBLE AS w FROM edges GROUP BY 1, 2), f0 AS MATERIALIZED (SELECT id AS root, id, 0.0::DOUBLE AS dist FROM ids WHERE {sql_draw('id', 0)} < {SAMPLED}::DOUBLE / (SELECT count(*) FROM ids))"]
    for k in range(1, rounds + 1):
        steps.append(f"f{k} AS MATERIALIZED (SELECT root, id, min(dist) AS dist FROM (SELECT * FROM f{k - 1} UNION ALL SELECT root, b, dist + w FROM f{k - 1} JOIN hops ON a = id) GROUP BY 1, 2)")
    return f"WITH {CONSEC}, {', '.join(steps)}, far AS (SELECT * FROM f{rounds})"


def _roots(g: Graph) -> DataFrame:
    return centrality.sample_roots(g, SAMPLED)


@query(_far_sql(20, "weight", False) + " SELECT t.root, t.id, t.dist, min(a) AS parent FROM far t LEFT JOIN (SELECT s.root, a, b, s.dist + w AS d FROM far s JOIN hops ON a = s.id) ON t.root = root_1 AND b = t.id AND abs(d - t.dist) < 1e-9 GROUP BY 1, 2, 3".replace("s.root, a", "s.root AS root_1, a"))
def g_dijkstra_forest(spark: SparkSession, d: str) -> DataFrame:
    g = consecutive_customers(spark, d)
    return centrality.dijkstra_forest(g, _roots(g), "weight").select("root", "id", "dist", "parent")


@query(_far_sql(12, "1", True) + " SELECT id, count(*) AS n_roots, round(avg(dist), 6) AS mean_dist FROM far WHERE root <> id GROUP BY id")
def g_closeness(spark: SparkSession, d: str) -> DataFrame:
    g = consecutive_customers(spark, d)
    return centrality.closeness(g, _roots(g)).select("id", "n_roots", F.round("mean_dist", 6).alias("mean_dist"))


@query(_far_sql(20, "weight", False) + " SELECT id, count(*) AS n_roots, round(avg(dist), 6) AS mean_dist FROM far WHERE root <> id GROUP BY id")
def g_prestige(spark: SparkSession, d: str) -> DataFrame:
    g = consecutive_customers(spark, d)
    return centrality.prestige(g, _roots(g), "weight").select("id", "n_roots", F.round("mean_dist", 6).alias("mean_dist"))


def _between_sql(hops: int) -> str:
    steps = ["dag AS MATERIALIZED (SELECT s.root, a, b, t.dist AS l FROM far s JOIN hops ON a = s.id JOIN far t ON t.root = s.root AND t.id = b AND t.dist = s.dist + 1)", "p0 AS (SELECT root, id, 1.0::DOUBLE AS s FROM f0)"]
    for k in range(1, hops + 1):
        steps.append(f"p{k} AS MATERIALIZED (SELECT dag.root, b AS id, sum(s) AS s FROM dag JOIN p{k - 1} p ON p.root = dag.root AND p.id = a WHERE l = {k} GROUP BY 1, 2)")
    steps.append(f"sigma AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM p{k}' for k in range(hops + 1))})")
    steps.append("share AS MATERIALIZED (SELECT dag.root, a, b, l, x.s / y.s AS f FROM dag JOIN sigma x ON x.root = dag.root AND x.id = a JOIN sigma y ON y.root = dag.root AND y.id = b)")
    steps.append(f"d{hops} AS (SELECT root, id, 0.0::DOUBLE AS d FROM p{hops})")
    for k in range(hops - 1, -1, -1):
        steps.append(f"d{k} AS MATERIALIZED (SELECT p.root, p.id, coalesce(sum(f * (1 + d)), 0) AS d FROM p{k} p LEFT JOIN (SELECT share.root, a, f, d FROM share JOIN d{k + 1} z ON z.root = share.root AND z.id = b) ON p.root = root_1 AND a = p.id GROUP BY 1, 2)".replace("SELECT share.root,", "SELECT share.root AS root_1,"))
    every = " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(1, hops + 1))
    return _far_sql(12, "1", False) + f", {', '.join(steps)} SELECT ids.id, round(coalesce(x, 0), 5) AS betweenness FROM ids LEFT JOIN (SELECT id AS i, sum(d) AS x FROM ({every}) GROUP BY 1) ON i = ids.id"


@query(_between_sql(12))
def g_betweenness(spark: SparkSession, d: str) -> DataFrame:
    g = consecutive_customers(spark, d)
    return centrality.betweenness(g, _roots(g)).select("id", F.round("betweenness", 5).alias("betweenness"))


# -- sources, sinks, growth --------------------------------------------------------------------------------------------
@query(f"WITH {BIP} SELECT f AS fmt, src, dst FROM edges, (VALUES ('snap'), ('tsv'), ('csv'), ('adj')) t(f)")
def g_text_formats(spark: SparkSession, d: str) -> DataFrame:
    """Each edge written as a line of each text format and parsed again."""
    e = customer_supplier(spark, d).edges
    written_as = {"snap": F.concat_ws("\t", "src", "dst"), "tsv": F.concat_ws(" ", "src", "dst"), "csv": F.concat_ws(",", "src", "dst"), "adj": F.concat_ws(" ", "src", F.lit(1), "dst")}
    out = None
    for fmt, line in written_as.items():
        rows = parse_edges(e.select(line.alias("line")), fmt)[0].select(F.lit(fmt).alias("fmt"), "src", "dst")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {TREE} SELECT src, dst FROM edges")
def g_adjacency_files(spark: SparkSession, d: str) -> DataFrame:
    """Saved as compressed adjacency lists and loaded again."""
    path = scratch_path(spark, "adj")
    save_graph(place_tree(spark, d), path, "adj")
    return load_graph(spark, path, "adj").edges.select("src", "dst")


@query(f"WITH {TREE} SELECT src, dst FROM edges")
def g_snapshot_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "snapshot")
    save_graph(place_tree(spark, d), path, "bin")
    return load_graph(spark, path, "bin").edges.select("src", "dst")


@query(f"WITH {TREE}, {PAIRS}, num AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM ids), b AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs) SELECT 0 AS n, (SELECT count(*) FROM ids) || ' ' || (SELECT count(*) FROM pairs) AS value UNION ALL SELECT p.n, coalesce(string_agg(q.n::VARCHAR, ' ' ORDER BY q.n), '') FROM num p LEFT JOIN b ON x = p.id LEFT JOIN num q ON q.id = y GROUP BY p.n")
def g_metis_lines(spark: SparkSession, d: str) -> DataFrame:
    return metis_lines(place_tree(spark, d))


_POWER = f"""WITH size AS (SELECT count(*) AS n FROM orders), ids AS MATERIALIZED (SELECT r AS id, n, {sql_draw('r', 0)} AS u, {sql_mixed('r', 0, 1)} % n AS b FROM size, range(n) t(r)),
cum AS MATERIALIZED (SELECT d, sum(p) OVER (ORDER BY d) / sum(p) OVER () AS c FROM (SELECT d, pow(d::DOUBLE, -2.1) AS p FROM size, range(1, n) t(d))),
drawn AS MATERIALIZED (SELECT id, n, b, d FROM ids ASOF JOIN cum ON u <= c), walk AS (SELECT id, n, b, unnest(range(1, d + 1)) AS k FROM drawn),
edges AS MATERIALIZED (SELECT id AS src, CASE WHEN (b + k * ({LAST_STEP} % n)) % n = id THEN (id + 1) % n ELSE (b + k * ({LAST_STEP} % n)) % n END AS dst FROM walk)
SELECT ids.id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM ids LEFT JOIN (SELECT dst, count(*) AS i FROM edges GROUP BY 1) ON dst = id LEFT JOIN (SELECT src, count(*) AS o FROM edges GROUP BY 1) ON src = id"""


@query(_POWER)
def g_powerlaw(spark: SparkSession, d: str) -> DataFrame:
    """A synthetic graph with as many vertices as there are orders."""
    return powerlaw(spark, table(spark, d, "orders").count()).degrees()


@query(components_sql(MATCH, ROUNDS, "SELECT id, component FROM final"))
def g_incremental_components(spark: SparkSession, d: str) -> DataFrame:
    """Components kept up to date over two batches of edges."""
    e = match_graph(spark, d).edges
    first = merge_components(None, e.filter("src < dst"))
    return merge_components(written(first, "components"), e.filter("src > dst"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS sum_value FROM events GROUP BY 1, 2")
def g_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """An extension: event-time windows, the same plan for a stream."""
    return event_windows(table(spark, d, "events")).withColumn("sum_value", F.round("sum_value", 4))
