"""Reading and writing graphs, ratings, points, matrices and models as text, binary or Parquet.

Readers are ``spark.read.text`` (local, HDFS or object stores; gzip by suffix; folders and globs) followed by column
expressions. A line that doesn't parse makes the query fail (``mode='fail'``) or is dropped (``mode='drop'``); blank
lines are skipped.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from weftgraph.functions.draws import draw, mixed
from weftgraph.graph import Graph

ISOLATED = 2**32 - 1  # fixed value: the target that marks a vertex without edges in bintsv4
LAST_STEP = 2_654_435_761  # fixed value: the stride of targets in the synthetic power-law graph


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) without blank lines; an empty path gives no lines."""
    if not path:
        return spark.createDataFrame([], "line string")
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")


def numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``lines`` with a number each; written, as such numbers may change from one evaluation to the next."""
    from weftgraph.session import written

    return written(lines(spark, path).withColumn(name, F.monotonically_increasing_id()), "lines")


def _checked(ok: Column, value: Column, mode: str, what: str) -> Column:
    # Lines that aren't data give NULL here too: filters may be evaluated in another order.
    line = F.col("line")
    skipped = (line == "") | (line.startswith("#") if what == "snap" else ~line.contains(",") if what == "csv" else F.lit(False))
    kept = F.when(skipped, F.lit(None).cast("long")).when(ok, value)
    return kept if mode == "drop" else kept.otherwise(F.raise_error(F.concat(F.lit(f"not a line of {what}: "), line)).cast("long"))


def _pair(df: DataFrame, separator: str, mode: str, what: str) -> DataFrame:
    p = F.split("line", separator)
    a, b = F.try_element_at(p, F.lit(1)).try_cast("long"), F.try_element_at(p, F.lit(2)).try_cast("long")
    ok = a.isNotNull() & b.isNotNull()
    return df.select(_checked(ok, a, mode, what).alias("src"), _checked(ok, b, mode, what).alias("dst")).filter("src IS NOT NULL")


def parse_edges(df: DataFrame, fmt: str, mode: str = "fail") -> tuple[DataFrame, DataFrame]:
    """((src, dst), (id) of vertices named without edges) of lines in snap, tsv, csv or adj format."""
    none = df.select(F.lit(None).cast("long").alias("id")).filter("id IS NOT NULL")
    if fmt == "snap":
        return _pair(df.filter(~F.col("line").startswith("#")), r"\s+", mode, fmt).filter("src <> dst"), none
    if fmt == "tsv":
        return _pair(df, r"\s+", mode, fmt), none
    if fmt == "csv":
        return _pair(df.filter(F.col("line").contains(",")), r"\s*,\s*", mode, fmt), none
    if fmt == "adj":
        p = F.split("line", r"[\s,]+")
        src, n = F.try_element_at(p, F.lit(1)).try_cast("long"), F.try_element_at(p, F.lit(2)).try_cast("int")
        targets = F.transform(F.slice(p, F.lit(3), F.greatest(F.size(p) - 2, F.lit(0))), lambda x: x.try_cast("long"))
        ok = src.isNotNull() & n.isNotNull() & (F.size(p) - 2 == n) & F.forall(targets, lambda x: x.isNotNull())
        rows = df.select(_checked(ok, src, mode, fmt).alias("src"), targets.alias("t")).filter("src IS NOT NULL")
        return rows.select("src", F.explode("t").alias("dst")), rows.filter(F.size("t") == 0).select(F.col("src").alias("id"))
    raise ValueError(f"unknown format: {fmt}")


def load_graph(spark: SparkSession, path: str, fmt: str, mode: str = "fail") -> Graph:
    """A graph from snap, tsv, csv, adj, bintsv4 or bin (a Parquet pair)."""
    if fmt == "bin":
        return Graph(spark.read.parquet(f"{path.rstrip('/')}/vertices"), spark.read.parquet(f"{path.rstrip('/')}/edges"))
    if fmt in ("journal", "graphjrl"):
        return load_journal(spark, path)
    edges, alone = read_bintsv4(spark, path) if fmt == "bintsv4" else parse_edges(lines(spark, path), fmt, mode)
    return Graph.build(edges, alone)


def parse_with(spark: SparkSession, path: str, parser: Callable[[str, str], Iterable[tuple]], vertex_schema: str = "id long", edge_schema: str = "src long, dst long") -> Graph:
    """A graph from lines that a function of the caller's parses: parser(file, line) gives any number of ``("v", {...})`` and
    ``("e", {...})``, rows of the two schemas; it runs on the executors, a batch of lines at a time. An exception fails the load.
    """
    kinds = {"v": vertex_schema, "e": edge_schema}
    schema = StructType([StructField(k, StructType.fromDDL(ddl)) for k, ddl in kinds.items()])
    arrow = to_arrow_schema(schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [{"v": row if kind == "v" else None, "e": row if kind == "e" else None} for file, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for kind, row in parser(file, line)]
            yield pa.RecordBatch.from_pylist(found, arrow)

    rows = spark.read.text(path).select(F.input_file_name().alias("file"), "value").mapInArrow(parse, schema)
    # Written once: vertices and edges are two readings of the same lines.
    from weftgraph.session import written

    rows = written(rows, "parsed")
    return Graph.build(rows.filter("e IS NOT NULL").select("e.*"), rows.filter("v IS NOT NULL").select("v.*"))


#: Bytes of a binary file that one row of the reader stands for; a multiple of a pair's eight.
PIECE = 64 << 20


def _files(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI (local, HDFS, object stores) and the path on it."""
    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), os.path.abspath(path))


def read_bintsv4(spark: SparkSession, path: str, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """Pairs of little-endian 32-bit ids. Files of any size: tasks read pieces of them."""
    fs, root = _files(path)
    given = fs.get_file_info(root)
    infos = [given] if given.type == FileType.File else [i for i in fs.get_file_info(FileSelector(root)) if i.type == FileType.File]
    pieces = [(i.path, at, min(piece, i.size - at)) for i in infos if not os.path.basename(i.path).startswith(("_", ".")) for at in range(0, i.size, piece)]
    listed = spark.createDataFrame(pieces, "file string, at long, n long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = _files(path)[0]
        for b in batches:
            for file, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_file(file) as f:
                    f.seek(at)
                    pairs = np.frombuffer(f.read(n), "<u4").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

    rows = listed.repartition(max(1, len(pieces)), "file", "at").mapInArrow(decode, "src long, dst long")
    return rows.filter(F.col("dst") != ISOLATED), rows.filter(F.col("dst") == ISOLATED).select(F.col("src").alias("id"))


def write_bintsv4(graph: Graph, path: str) -> None:
    """One file for each partition, written by the tasks to the file system that ``path`` names (a URI, or a folder that all
    executors share). A file is written under another name and moved, so that a second attempt replaces the first."""
    _files(path)[0].create_dir(_files(path)[1], recursive=True)
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    alone = graph.vertices.select("id").join(ends, "id", "left_anti").select(F.col("id").alias("src"), F.lit(ISOLATED).cast("long").alias("dst"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = _files(path)
        name = f"{root}/part-{context.partitionId():05d}.bin"
        draft, n = f"{root}/_{context.partitionId():05d}.{context.taskAttemptId()}", 0
        with fs.open_output_stream(draft) as f:
            for b in batches:
                pairs = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
                if len(pairs) and (pairs.min() < 0 or pairs.max() > ISOLATED):
                    raise ValueError("an id doesn't fit into 32 bits")
                f.write(pairs.astype("<u4").tobytes())
                n += len(pairs)
        fs.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    graph.edges.select("src", "dst").unionByName(alone).mapInArrow(store, "n long").agg(F.sum("n")).collect()


def save_graph(graph: Graph, path: str, fmt: str, gzip: bool = True) -> None:
    """Write snap or tsv (edges), adj, csv, metis, hypergraph, bintsv4, or bin (everything, as a Parquet pair)."""
    if fmt == "bin":
        graph.vertices.write.mode("overwrite").parquet(f"{path.rstrip('/')}/vertices")
        graph.edges.write.mode("overwrite").parquet(f"{path.rstrip('/')}/edges")
    elif fmt in ("snap", "tsv", "csv"):
        save_lines(graph.edges.select(F.concat_ws("," if fmt == "csv" else "\t", "src", "dst").alias("value")), path, gzip)
    elif fmt == "adj":
        out = graph.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("t"))
        full = graph.vertices.select("id").join(out, "id", "left").select("id", F.coalesce("t", F.array().cast("array<long>")).alias("t"))
        save_lines(full.select(F.concat_ws(" ", F.col("id"), F.size("t"), F.concat_ws(" ", F.transform("t", lambda x: x.cast("string")))).alias("value")).select(F.trim("value").alias("value")), path, gzip)
    elif fmt == "metis":
        save_lines(metis_lines(graph).orderBy("n").select("value"), path, gzip)
    elif fmt == "hypergraph":
        save_lines(hypergraph_lines(graph), path, gzip)
    elif fmt == "bintsv4":
        write_bintsv4(graph, path)
    elif fmt in ("journal", "graphjrl"):
        save_journal(graph, path, gzip)
    else:
        raise ValueError(f"unknown format: {fmt}")


def save_lines(df: DataFrame, path: str, gzip: bool = True) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def save_rows(graph: Graph, path: str, vertex: Column | None = None, edge: Column | None = None, gzip: bool = True) -> None:
    """Text made by the caller for each vertex and each edge (a NULL line is left out)."""
    for frame, line, name in ((graph.vertices, vertex, "vertices"), (graph.edges, edge, "edges")):
        if line is not None:
            save_lines(frame.select(line.cast("string").alias("value")).filter("value IS NOT NULL"), f"{path.rstrip('/')}/{name}", gzip)


def save_journal(graph: Graph, path: str, gzip: bool = True) -> None:
    """One JSON object a line: vertices as {"v": ...}, edges as {"e": ...}."""
    v = graph.vertices.select(F.to_json(F.struct(F.struct("*").alias("v"))).alias("value"))
    e = graph.edges.select(F.to_json(F.struct(F.struct("*").alias("e"))).alias("value"))
    save_lines(v.unionByName(e), path, gzip)


def load_journal(spark: SparkSession, path: str, vertex_schema: str = "id long", edge_schema: str = "src long, dst long") -> Graph:
    rows = lines(spark, path).select(F.from_json("line", f"v struct<{_colons(vertex_schema)}>, e struct<{_colons(edge_schema)}>").alias("r"))
    return Graph(rows.filter("r.v IS NOT NULL").select("r.v.*"), rows.filter("r.e IS NOT NULL").select("r.e.*"))


def _colons(schema: str) -> str:
    return ", ".join(":".join(part.strip().split(" ", 1)) for part in schema.split(","))


def convert(spark: SparkSession, source: str, source_fmt: str, target: str, target_fmt: str, gzip: bool = True) -> None:
    save_graph(load_graph(spark, source, source_fmt), target, target_fmt, gzip)


def metis_lines(graph: Graph) -> DataFrame:
    """(n, value): the header as n = 0, then for each vertex in id order its undirected neighbours, numbered from 1.

    Numbering all vertices in order takes a sort; places come from counts per range, never from one task.
    """
    ids = numbered(graph.vertices.select("id"), "id", "n")
    pairs = graph.undirected()
    both = pairs.select(F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))))
    near = both.join(ids.toDF("b", "nb"), "b").groupBy("a").agg(F.sort_array(F.collect_list("nb")).alias("t"))
    body = ids.join(near, F.col("id") == F.col("a"), "left").select("n", F.concat_ws(" ", F.transform("t", lambda x: x.cast("string"))).alias("value"))
    head = ids.agg(F.count("*").alias("v")).crossJoin(F.broadcast(pairs.agg(F.count("*").alias("e"))))
    return head.select(F.lit(0).cast("long").alias("n"), F.concat_ws(" ", "v", "e").alias("value")).unionByName(body)


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with places 1, 2, ... in the order of a unique column, without gathering the rows in one task."""
    placed = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("__m", F.monotonically_increasing_id())
    part, local = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    from weftgraph.session import written

    # Written, as the ids must not change between the two uses.
    placed = written(placed.withColumns({"__p": part, "__l": local}).drop("__m"), "numbered")
    sizes = placed.groupBy("__p").agg(F.count("*").alias("c")).orderBy("__p").collect()  # a row per partition
    before, rows = 0, []
    for r in sizes:
        rows.append((r["__p"], before))
        before += r["c"]
    starts = df.sparkSession.createDataFrame(rows, "__p long, __b long")
    return placed.join(F.broadcast(starts), "__p").withColumn(name, F.col("__b") + F.col("__l") + 1).drop("__p", "__l", "__b")


def hypergraph_lines(graph: Graph) -> DataFrame:
    """A line for each vertex: its id, the number of its undirected edges and their numbers."""
    pairs = graph.undirected().select("src", "dst", F.concat_ws("-", F.format_string("%019d", "src"), F.format_string("%019d", "dst")).alias("k"))
    edges = numbered(pairs, "k", "e")
    per = edges.select("e", F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("t"))
    return per.select(F.concat_ws(" ", "id", F.size("t"), F.concat_ws(" ", F.transform("t", lambda x: x.cast("string")))).alias("value"))


#: Degrees up to this have their cumulative distribution in a table.
POWERLAW_TABLE = 1_000_000


def _power_sum(first: int, last: np.ndarray, alpha: float) -> np.ndarray:
    """The sum of d^-alpha for d from ``first`` (large) to each of ``last``."""
    a, b = float(first), last.astype(float)
    area = np.log(b / a) if alpha == 1 else (b ** (1 - alpha) - a ** (1 - alpha)) / (1 - alpha)
    return np.where(b < a, 0.0, area + (a**-alpha + b**-alpha) / 2 + alpha * (a ** (-alpha - 1) - b ** (-alpha - 1)) / 12)


def powerlaw(spark: SparkSession, n: int, alpha: float = 2.1, truncate: int | None = None, seed: int = 0, reverse: bool = False) -> Graph:
    """A directed graph of n vertices whose out-degrees follow P(d) ~ d^-alpha (in-degrees, if ``reverse``).

    The distribution of the degrees up to POWERLAW_TABLE is sent to every task; beyond, sums are made by the Euler-Maclaurin
    formula and inverted by bisection. Targets walk by a fixed stride, so an edge needs no draw of its own and a loop is
    stepped over.
    """
    most = min(n - 1, truncate or n - 1)
    if most < 1:
        return Graph(spark.range(n), spark.createDataFrame([], "src long, dst long"))
    known = min(most, POWERLAW_TABLE)
    cumulative = (np.arange(1, known + 1, dtype=float) ** -alpha).cumsum()
    whole = cumulative[-1] + float(_power_sum(known + 1, np.array([most]), alpha)[0])
    sent = spark.sparkContext.broadcast(cumulative / whole)

    def degrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = b.column(1).to_numpy()
            d = np.searchsorted(sent.value, u) + 1
            far = np.flatnonzero(d > known)
            if len(far) and most > known:
                rest = (u[far] - sent.value[-1]) * whole
                low, high = np.full(len(far), known + 1), np.full(len(far), most)
                while (low < high).any():
                    middle = (low + high) // 2
                    enough = _power_sum(known + 1, middle, alpha) >= rest
                    low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
                d[far] = low
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.minimum(d, most), pa.int64())], ["id", "d"])

    drawn = spark.range(n).select("id", draw(F.col("id"), seed).alias("u")).mapInArrow(degrees, "id long, d long")
    begin = F.pmod(mixed(F.col("id"), seed, 1), F.lit(n))
    # Large degrees are walked in portions, so no array is longer than one.
    portion = F.lit(100_000).cast("long")
    parts = drawn.select("id", "d", begin.alias("b"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("d"), portion)).alias("f"))
    walk = parts.select("id", "b", F.explode(F.sequence("f", F.least("d", F.col("f") + portion - 1))).alias("k"))
    target = F.pmod(F.col("b") + F.col("k") * (LAST_STEP % n), F.lit(n))
    stepped = F.when(target == F.col("id"), F.pmod(target + 1, F.lit(n))).otherwise(target)
    ends = walk.select(F.col("id").alias("src"), stepped.alias("dst"))
    return Graph(spark.range(n), ends.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else ends)


# -- other inputs ------------------------------------------------------------------------------------------------------
def read_ratings(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """(user, item, rating[, weight], role): ``user item [rating [weight]]``; the role from the suffix of the file, or of the
    folder that a job wrote its parts to."""
    rows = spark.read.text(path).select(F.trim("value").alias("line"), F.input_file_name().alias("file")).filter("line <> ''")
    p = F.split("line", r"[\s,]+")
    name = F.regexp_replace("file", r"(/part-[^/]*|\.gz)$", "")
    role = F.when(name.endswith(".validate"), "validate").when(name.endswith(".predict"), "predict").otherwise("train")
    at = lambda k, kind: F.try_element_at(p, F.lit(k)).try_cast(kind)
    cols = {"user": at(1, "long"), "item": at(2, "long"), "rating": at(3, "double")}
    if weighted:
        cols["weight"] = F.coalesce(at(4, "double"), F.lit(1.0))
    return rows.select(*(x.alias(c) for c, x in cols.items()), role.alias("role")).filter("user IS NOT NULL AND item IS NOT NULL")


def item_vertex(item: Column) -> Column:
    """The vertex id of an item in a graph of users and items."""
    return -(item + 2)


def read_clicks(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, label, feature): ``label feat:1 feat:1 ...`` with label 1 or -1; rows are numbered by the reader, once."""
    p = F.split("line", r"\s+")
    rows = numbered_lines(spark, path, "row_id")
    feats = F.transform(F.slice(p, F.lit(2), F.size(p) - 1), lambda x: F.split(x, ":")[0].try_cast("long"))
    return rows.select("row_id", p[0].try_cast("int").alias("label"), F.explode(feats).alias("feature"))


def read_points(spark: SparkSession, path: str, ids: bool = False, sparse: bool = False, dim: int | None = None) -> DataFrame:
    """(id, point): numbers apart by spaces or commas; sparse: ``index:value``. Without ids, rows are numbered by the reader."""
    p = F.split("line", r"[\s,]+")
    rows = lines(spark, path).withColumn("id", p[0].try_cast("long")) if ids else numbered_lines(spark, path, "id")
    cells = F.slice(p, F.lit(2), F.size(p) - 1) if ids else p
    if not sparse:
        return rows.select("id", F.transform(cells, lambda x: x.try_cast("double")).alias("point"))
    pairs = F.map_from_entries(F.transform(cells, lambda x: F.struct(F.split(x, ":")[0].try_cast("int").alias("i"), F.split(x, ":")[1].try_cast("double").alias("v"))))
    keyed = rows.select("id", pairs.alias("m"))
    if dim is None:
        dim = (keyed.agg(F.max(F.array_max(F.map_keys("m")))).first()[0] or -1) + 1
    return keyed.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("point"))


def read_weighted_edges(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, w): three numbers with any single separator; the weight defaults to 1."""
    p = F.split("line", r"[\s,;:|]+")
    return lines(spark, path).select(p[0].try_cast("long").alias("i"), p[1].try_cast("long").alias("j"), F.coalesce(F.try_element_at(p, F.lit(3)).try_cast("double"), F.lit(1.0)).alias("w")).filter("i IS NOT NULL AND j IS NOT NULL")


def read_counts(spark: SparkSession, path: str, cap: int = 100) -> DataFrame:
    """(doc, word, n) with n capped."""
    p = F.split("line", r"[\s,]+")
    return lines(spark, path).select(p[0].try_cast("long").alias("doc"), p[1].try_cast("long").alias("word"), F.least(F.try_element_at(p, F.lit(3)).try_cast("long"), F.lit(cap)).alias("n")).filter("doc IS NOT NULL AND word IS NOT NULL AND n IS NOT NULL")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) as written, 0- or 1-based."""
    return read_weighted_edges(spark, path).withColumnRenamed("w", "v")


def read_labelled_adjacency(spark: SparkSession, path: str) -> Graph:
    """``vid label nbr nbr ...``: vertices (id, label) and edges."""
    p = F.split("line", r"\s+")
    rows = lines(spark, path).select(p[0].try_cast("long").alias("id"), F.try_element_at(p, F.lit(2)).alias("label"), F.slice(p, F.lit(3), F.greatest(F.size(p) - 2, F.lit(0))).alias("t")).filter("id IS NOT NULL")
    edges = rows.select(F.col("id").alias("src"), F.explode(F.transform("t", lambda x: x.try_cast("long"))).alias("dst"))
    return Graph.build(edges, rows.select("id", "label"))


def read_weighted_adjacency(spark: SparkSession, path: str) -> Graph:
    """``vid nbr weight nbr weight ...``."""
    p = F.split("line", r"\s+")
    rows = lines(spark, path).select(p[0].try_cast("long").alias("id"), F.slice(p, F.lit(2), F.size(p) - 1).alias("t")).filter("id IS NOT NULL")
    at = lambda k: F.col("t")[k]
    pairs = F.transform(F.sequence(F.lit(0), (F.size("t") / 2).cast("int") - 1), lambda k: F.struct(at((2 * k).cast("int")).try_cast("long").alias("dst"), at((2 * k + 1).cast("int")).try_cast("double").alias("weight")))
    edges = rows.filter(F.size("t") >= 2).withColumn("e", F.explode(pairs)).select(F.col("id").alias("src"), "e.dst", "e.weight")
    return Graph.build(edges, rows.select("id"))


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """(id, component) of ``vid,component`` lines."""
    p = F.split("line", r"\s*,\s*")
    return lines(spark, path).select(p[0].try_cast("long").alias("id"), p[1].try_cast("long").alias("component"))


def read_priors(spark: SparkSession, path: str, logs: bool = False) -> DataFrame:
    """(id, prior) of ``id p0 p1 ...``; probabilities are turned into logs."""
    p = F.split("line", r"[\s,]+")
    value = (lambda x: x.try_cast("double")) if logs else (lambda x: F.log(F.greatest(x.try_cast("double"), F.lit(1e-300))))
    return lines(spark, path).select(p[0].try_cast("long").alias("id"), F.transform(F.slice(p, F.lit(2), F.size(p) - 1), value).alias("prior"))


#: A network of one text is parsed on the driver; larger ones come as lines of factors (``read_line_factors``).
MARKOV_BYTES = 256 << 20


def read_markov(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((id, prior), (fid, scope, sizes, logp)) of a MARKOV network text: one file of at most MARKOV_BYTES, parsed on the driver."""
    fs, root = _files(path)
    given = fs.get_file_info(root)
    size = given.size if given.type == FileType.File else sum(i.size or 0 for i in fs.get_file_info(FileSelector(root)))
    if size > MARKOV_BYTES:
        raise ValueError("the network is too large to be parsed in one piece")
    text = " ".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one model file
    words = iter(text.split())
    if next(words).upper() != "MARKOV":
        raise ValueError("not a MARKOV network")
    n = int(next(words))
    sizes = [int(next(words)) for _ in range(n)]
    scopes = []
    for _ in range(int(next(words))):
        scopes.append([int(next(words)) for _ in range(int(next(words)))])
    rows = []
    for f, scope in enumerate(scopes):
        cells = [float(next(words)) for _ in range(int(next(words)))]
        rows.append((f, scope, [sizes[v] for v in scope], [float(np.log(max(c, 1e-300))) for c in cells]))
    variables = spark.createDataFrame([(i, [0.0] * k) for i, k in enumerate(sizes)], "id long, prior array<double>")
    return variables, spark.createDataFrame(rows, "fid long, scope array<long>, sizes array<int>, logp array<double>")


def read_line_factors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((id, prior), (fid, scope, sizes, logp)) of lines ``v id size`` (a variable), ``d n id vars... sizes... values...`` (a factor
    of n variables) and ``u id var size values...`` (of one). Values are taken to logarithms of base 10, as this format has it."""
    p = F.split("line", r"\s+")
    rows = lines(spark, path).select(p.alias("p"), p[0].alias("kind"))
    number = lambda k: F.col("p")[k].try_cast("long")
    cut = lambda first, n: F.slice("p", first, n)
    variables = rows.filter("kind = 'v'").select(number(1).alias("id"), F.array_repeat(F.lit(0.0), number(2).cast("int")).alias("prior"))
    n = F.when(F.col("kind") == "d", number(1)).otherwise(1).cast("int")
    skip = F.when(F.col("kind") == "d", 4).otherwise(3)
    factors = rows.filter("kind IN ('d', 'u')").select("p", F.when(F.col("kind") == "d", number(2)).otherwise(number(1)).alias("fid"), n.alias("n"), skip.alias("skip"))
    value = lambda x: F.log10(F.greatest(x.cast("double"), F.lit(1e-300)))
    left = F.greatest(F.size("p") - F.col("skip") - 2 * F.col("n") + 1, F.lit(0))
    return variables, factors.select(
        "fid",
        F.transform(cut(F.col("skip"), F.col("n")), lambda x: x.cast("long")).alias("scope"),
        F.transform(cut(F.col("skip") + F.col("n"), F.col("n")), lambda x: x.cast("int")).alias("sizes"),
        F.transform(cut(F.col("skip") + 2 * F.col("n"), left), value).alias("logp"),
    )
