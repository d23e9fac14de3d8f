"""Queries that write tables in a format and read them again, for every reader and writer, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.plans.graph_queries import CONSEC, OFFSET, PAIRS, TREE, consecutive_customers, place_tree
from weftgraph.plans.ml_queries import _RATINGS, clean_ratings, points
from weftgraph.plans.tables import table
from weftgraph.session import scratch_path
from weftgraph.sources import graphs as io

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def _written(df: DataFrame, line: Column, name: str, suffix: str = "") -> str:
    """The path of a folder of text with a line for each row."""
    path = scratch_path(df.sparkSession, name) + suffix
    io.save_lines(df.select(line.cast("string").alias("value")), path)
    return path


def _spaced(*columns: str | Column) -> Column:
    return F.concat_ws(" ", *(F.col(c) if isinstance(c, str) else c for c in columns))


def _texts(array: str) -> Column:
    return F.concat_ws(" ", F.transform(array, lambda x: x.cast("string")))


# -- graphs ------------------------------------------------------------------------------------------------------------
def arrow_lines(file: str, line: str) -> Iterator[tuple]:
    """``a -> b, c`` (edges from a) and ``@a name`` (a vertex with a name)."""
    if line.startswith("@"):
        a, name = line[1:].split(" ", 1)
        yield "v", {"id": int(a), "name": name}
    elif m := re.fullmatch(r"(\d+) -> ([\d, ]+)", line):
        for b in m[2].split(","):
            yield "e", {"src": int(m[1]), "dst": int(b)}


_NAMED = f"WITH {TREE} SELECT ids.id, n_name AS name, (SELECT count(*) FROM edges WHERE dst = ids.id) AS in_degree FROM ids LEFT JOIN nation ON n_nationkey + {2 * OFFSET} = ids.id"


@query(_NAMED)
def g_line_parser(spark: SparkSession, d: str) -> DataFrame:
    """A format of the caller's, parsed by the caller's function: edges and names of vertices in one file."""
    e = place_tree(spark, d).edges.groupBy("src").agg(F.concat_ws(", ", F.collect_list(F.col("dst").cast("string"))).alias("t"))
    edges = e.select(F.concat_ws(" -> ", "src", "t").alias("line"))
    names = table(spark, d, "nation").select(F.concat(F.lit("@"), F.col("n_nationkey") + 2 * OFFSET, F.lit(" "), "n_name").alias("line"))
    g = io.parse_with(spark, _written(edges.unionByName(names), F.col("line"), "arrows"), arrow_lines, "id long, name string")
    return g.vertices.join(g.degrees().select("id", "in_degree"), "id")


@query(f"WITH {CONSEC} SELECT src, dst FROM edges")
def g_journal_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "journal")
    io.save_graph(consecutive_customers(spark, d), path, "journal")
    return io.load_graph(spark, path, "journal").edges.select("src", "dst")


@query(f"WITH {CONSEC} SELECT src, dst FROM edges")
def g_bintsv4_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "bintsv4")
    io.save_graph(consecutive_customers(spark, d), path, "bintsv4")
    return io.load_graph(spark, path, "bintsv4").edges.select("src", "dst")


@query(f"WITH {CONSEC}, {PAIRS}, num AS (SELECT a, b, row_number() OVER (ORDER BY a, b) AS e FROM pairs), ends AS (SELECT a AS id, e FROM num UNION ALL SELECT b, e FROM num) SELECT id || ' ' || count(*) || ' ' || string_agg(e::VARCHAR, ' ' ORDER BY e) AS value FROM ends GROUP BY id")
def g_hypergraph_lines(spark: SparkSession, d: str) -> DataFrame:
    return io.hypergraph_lines(consecutive_customers(spark, d))


@query(f"WITH {CONSEC} SELECT src, dst FROM edges")
def g_converted_files(spark: SparkSession, d: str) -> DataFrame:
    """Saved as snap, converted to adjacency lists and loaded again."""
    a, b = scratch_path(spark, "snap"), scratch_path(spark, "adj")
    io.save_graph(consecutive_customers(spark, d), a, "snap")
    io.convert(spark, a, "snap", b, "adj")
    return io.load_graph(spark, b, "adj").edges.select("src", "dst")


@query(f"WITH {CONSEC}, near AS (SELECT DISTINCT src, dst FROM edges) SELECT id, (SELECT any_value(c_mktsegment) FROM customer WHERE c_custkey = id) AS label, (SELECT count(*) FROM near WHERE src = id) AS out_degree FROM ids")
def g_labelled_adjacency_files(spark: SparkSession, d: str) -> DataFrame:
    near = consecutive_customers(spark, d).edges.groupBy(F.col("src").alias("c_custkey")).agg(F.collect_set("dst").alias("t"))
    every = table(spark, d, "customer").join(near, "c_custkey", "left")
    path = _written(every, F.trim(_spaced("c_custkey", "c_mktsegment", _texts("t"))), "labelled")
    g = io.read_labelled_adjacency(spark, path)
    linked = Graph.build(g.edges)
    return linked.degrees().select("id", "out_degree").join(g.vertices, "id").select("id", "label", "out_degree")


@query(f"WITH {CONSEC} SELECT src, dst, max(weight) AS weight FROM edges GROUP BY 1, 2")
def g_weighted_adjacency_files(spark: SparkSession, d: str) -> DataFrame:
    e = consecutive_customers(spark, d).edges.groupBy("src", "dst").agg(F.max("weight").alias("w"))
    rows = e.groupBy("src").agg(F.concat_ws(" ", F.collect_list(_spaced("dst", "w"))).alias("t"))
    return io.read_weighted_adjacency(spark, _written(rows, _spaced("src", "t"), "weighted")).edges.select("src", "dst", "weight")


@query(f"WITH {CONSEC} SELECT src AS i, dst AS j, weight AS w FROM edges")
def g_weighted_edge_files(spark: SparkSession, d: str) -> DataFrame:
    return io.read_weighted_edges(spark, _written(consecutive_customers(spark, d).edges, F.concat_ws(";", "src", "dst", "weight"), "edges"))


@query("SELECT s_suppkey AS id, s_nationkey::BIGINT AS component FROM supplier")
def g_component_files(spark: SparkSession, d: str) -> DataFrame:
    return io.read_components(spark, _written(table(spark, d, "supplier"), F.concat_ws(",", "s_suppkey", "s_nationkey"), "components"))


# -- learning ----------------------------------------------------------------------------------------------------------
@query(f'WITH {_RATINGS} SELECT "user", item, rating, role FROM ratings_clean')
def m_rating_files(spark: SparkSession, d: str) -> DataFrame:
    """Folders whose suffix tells the role."""
    r = clean_ratings(spark, d)
    base = scratch_path(spark, "ratings")
    for role, suffix in (("train", ""), ("validate", ".validate"), ("predict", ".predict")):
        io.save_lines(r.filter(F.col("role") == role).select(F.trim(_spaced("user", "item", "rating")).alias("value")), f"{base}/r{suffix}")
    return io.read_ratings(spark, f"{base}/*")


@query(f'WITH {_RATINGS} SELECT "user", item, rating, CASE WHEN item % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM ratings_clean WHERE role = \'train\'')
def m_weighted_rating_files(spark: SparkSession, d: str) -> DataFrame:
    """Every other item has a weight of a half, the rest none written."""
    r = clean_ratings(spark, d).filter("role = 'train'")
    half = F.when(F.pmod("item", F.lit(2)) == 0, "0.5")
    return io.read_ratings(spark, _written(r, _spaced("user", "item", "rating", half), "weighted"), weighted=True).select("user", "item", "rating", "weight")


@query("SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS label, feature, count(*) AS n FROM (SELECT l_returnflag, unnest([l_suppkey, 1000000 + l_linenumber]) AS feature FROM lineitem) GROUP BY 1, 2")
def m_click_files(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "R", "1").otherwise("-1")
    line = F.concat(label, F.lit(" "), F.col("l_suppkey"), F.lit(":1 "), F.col("l_linenumber") + 1_000_000, F.lit(":1"))
    return io.read_clicks(spark, _written(table(spark, d, "lineitem"), line, "clicks")).groupBy("label", "feature").agg(F.count("*").alias("n"))


_POINTS = "SELECT vec_id AS id, embedding::DOUBLE[] AS point FROM embeddings"


@query(_POINTS)
def m_point_files(spark: SparkSession, d: str) -> DataFrame:
    return io.read_points(spark, _written(points(spark, d), _spaced("id", _texts("point")), "points"), ids=True)


@query(_POINTS)
def m_sparse_point_files(spark: SparkSession, d: str) -> DataFrame:
    """Only the entries that aren't 0 are written."""
    cells = F.filter(F.transform("point", lambda x, i: F.when(x != 0, F.concat_ws(":", i, x))), lambda x: x.isNotNull())
    return io.read_points(spark, _written(points(spark, d), _spaced("id", F.concat_ws(" ", cells)), "points"), ids=True, sparse=True)


@query("SELECT l_orderkey AS doc, l_partkey AS word, least(sum(l_quantity), 100)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def m_count_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents are orders and words are parts; counts are capped on reading."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("n"))
    return io.read_counts(spark, _written(n, _spaced("l_orderkey", "l_partkey", "n"), "counts"))


@query("SELECT vec_id AS i, k - 1 AS j, x AS v FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings)")
def m_matrix_files(spark: SparkSession, d: str) -> DataFrame:
    cells = points(spark, d).select("id", F.posexplode("point").alias("k", "x"))
    return io.read_matrix(spark, _written(cells, _spaced("id", "k", "x"), "matrix"))


@query("SELECT c_custkey AS id, [round(ln(0.2), 6), round(ln(0.3), 6), round(ln(0.5), 6)] AS prior FROM customer")
def m_prior_files(spark: SparkSession, d: str) -> DataFrame:
    path = _written(table(spark, d, "customer"), _spaced("c_custkey", F.lit("0.2 0.3 0.5")), "priors")
    return io.read_priors(spark, path).select("id", F.transform("prior", lambda x: F.round(x, 6)).alias("prior"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS fid, [n_nationkey::BIGINT, 25 + n_regionkey::BIGINT] AS scope, [2, 2] AS sizes, [0.0, round(ln(0.5), 6), round(ln(0.25), 6), 0.0]::DOUBLE[] AS logp FROM nation")
def m_markov_file(spark: SparkSession, d: str) -> DataFrame:
    """A network of nations and regions as one text."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()  # 25 of them
    text = " ".join(["MARKOV", "30", "2 " * 30, str(len(rows)), *(f"2 {n} {25 + r}" for n, r in rows), *("4 1 0.5 0.25 1" for _ in rows)])
    frame = spark.createDataFrame([(text,)], "text string").coalesce(1)
    return io.read_markov(spark, _written(frame, F.col("text"), "markov"))[1].select("fid", "scope", "sizes", F.transform("logp", lambda x: F.round(x, 6)).alias("logp"))


@query("SELECT s_suppkey + 1000 AS fid, [s_suppkey, 500 + s_nationkey] AS scope, [2, 2] AS sizes, [0.0, -1.0, -2.0, 0.0]::DOUBLE[] AS logp FROM supplier UNION ALL SELECT 5000 + n_nationkey, [500 + n_nationkey], [2], [-1.0, 0.0]::DOUBLE[] FROM nation")
def m_line_factor_files(spark: SparkSession, d: str) -> DataFrame:
    """Variables, factors of two variables and of one, a line each."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    both = s.select(F.concat_ws(" ", F.lit("d 2"), F.col("s_suppkey") + 1000, "s_suppkey", F.col("s_nationkey") + 500, F.lit("2 2 1 0.1 0.01 1")).alias("line"))
    own = n.select(F.concat_ws(" ", F.lit("u"), F.col("n_nationkey") + 5000, F.col("n_nationkey") + 500, F.lit("2 0.1 1")).alias("line"))
    variables = s.select(F.concat_ws(" ", F.lit("v"), "s_suppkey", F.lit("2")).alias("line"))
    return io.read_line_factors(spark, _written(both.unionByName(own).unionByName(variables), F.col("line"), "factors"))[1]
