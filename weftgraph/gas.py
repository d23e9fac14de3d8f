"""Gather-Apply-Scatter programs on a synchronous runner.

A program is a set of Column expressions. In a superstep the vertices that hold a message (or all) gather over their
edges from the states before the step, apply, and then scatter from the states after it; messages to a vertex are
combined by an aggregate before they arrive. Only what changed is written: a step reads the rows of active vertices, and
their new values lie in a patch over the table of all states, which is written anew when the patch has grown to a quarter of
it. Of the neighbours only the columns that an expression names are joined; the edges are scanned, never rewritten (unless a
program writes to them). Every table lies in the shared folder, which also cuts the lineage.

In expressions: ``c_<col>`` is the center's column, ``n_<col>`` the neighbour's, edge columns have their own names;
``msg`` is the combined message, ``acc_<name>`` a gathered total, ``ctx_iteration``, ``ctx_num_vertices`` and
``ctx_num_edges`` what the runner knows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Dir, Graph, VertexSet
from weftgraph.session import BROADCAST_ROWS, forget, small_or_plain, written, written_counted


@dataclass(frozen=True)
class VertexProgram:
    """gather: name -> aggregate over the gather edges; gather_default: totals of a vertex without such edges; gather_dir may
    be a column of ``c_`` columns that gives each vertex its own direction (0 none, 1 in, 2 out, 3 both).
    apply: column -> new value; scatter_if: whether an edge carries a message (states after apply, ``c_old_<col>`` the
    center's before); message: its value; combine: the aggregate for messages to one vertex.
    edge_update: new values of edge columns for the scatter edges of active vertices (with ALL, first seen from the source,
    then from the target)."""

    apply: Mapping[str, Column]
    gather_dir: Dir | Column = Dir.IN
    gather: Mapping[str, Column] = field(default_factory=dict)
    gather_default: float = 0.0
    scatter_dir: Dir = Dir.OUT
    scatter_if: Column | None = None
    message: Column | None = None
    combine: Callable[[Column], Column] = F.sum
    init: Mapping[str, Column] = field(default_factory=dict)
    edge_update: Mapping[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class RunResult:
    graph: Graph
    status: str  # TASK_DEPLETION, TIMEOUT, FORCED_ABORT, MAX_ITERATIONS or EXCEPTION
    iterations: int
    updates: int
    aggregates: dict[str, list]
    error: Exception | None = None


@dataclass(frozen=True)
class Aggregator:
    """A named aggregate over vertices or edges, with a finalizer; run every ``every`` supersteps (0: on request), or, with
    ``seconds``, after the first superstep that ends so long after the last time."""

    aggregates: Mapping[str, Column]
    over: str = "vertices"
    every: int = 1
    finalize: Callable[[dict], object] = lambda row: row
    seconds: float | None = None

    def now(self, graph: Graph) -> object:
        frame = graph.vertices if self.over == "vertices" else graph.triplets()
        return self.finalize(frame.agg(*(x.alias(c) for c, x in self.aggregates.items())).first().asDict())


def signals(vset: VertexSet, message: Column | None = None) -> DataFrame:
    """Messages (id, msg) to every vertex of a set."""
    return vset.frame().select("id", (F.lit(0.0) if message is None else message).alias("msg"))


def transform_and_signal(graph: Graph, columns: Mapping[str, Column], signal: Column, message: Column | None = None, vset: VertexSet | None = None) -> tuple[Graph, DataFrame]:
    """A transform of vertices that also signals those (of the set) for which ``signal`` holds afterwards: (graph, messages)."""
    done = graph.transform_vertices(columns, vset)
    chosen = done.select(signal, vset)
    return done, chosen.graph.vertices.join(chosen.ids, "id", "left_semi").select("id", (F.lit(0.0) if message is None else message).alias("msg"))


def map_reduce_and_signal(graph: Graph, aggregates: Mapping[str, Column], signal: Column, message: Column | None = None, vset: VertexSet | None = None) -> tuple[DataFrame, DataFrame]:
    """One row of aggregates over the vertices, and messages to those (of the set) for which ``signal`` holds."""
    rows = graph._within(graph.vertices, vset)
    return graph.map_reduce_vertices(aggregates, vset), rows.filter(signal).select("id", (F.lit(0.0) if message is None else message).alias("msg"))


def _named(prefix: str, columns: list[str], expressions: list[Column | None]) -> list[str]:
    """The columns that occur with the prefix in any of the expressions; all where their text is cut short."""
    text = " ".join(str(x) for x in expressions if x is not None)
    if "more fields" in text:
        return columns
    return [c for c in columns if prefix + c in text]


class _States:
    """The table of all states and a patch of those that changed since it was written."""

    def __init__(self, vertices: DataFrame) -> None:
        self.columns = vertices.columns
        self.base, self.size = written_counted(vertices, "state")
        self.patch: DataFrame | None = None
        self.patched = 0

    def frame(self, *columns: str) -> DataFrame:
        wanted = ["id", *columns] if columns else self.columns
        if self.patch is None:
            return self.base.select(*wanted)
        rest = self.base.join(small_or_plain(self.patch.select("id"), self.patched), "id", "left_anti")
        return rest.select(*wanted).unionByName(self.patch.select(*wanted))

    def of(self, ids: DataFrame, n: int) -> DataFrame:
        """The states of some vertices, with the further columns of ``ids``."""
        return self.frame().join(small_or_plain(ids, n), "id")

    def replaced(self, applied: DataFrame, names: list[str]) -> tuple[DataFrame, int]:
        """The rows of a small table that changed, and their number, after it was written whole with the new values."""
        new = applied.select("id", F.struct("*").alias("__new"))
        merged = self.base.select(*self.columns).join(new, "id", "left").withColumn("__on", F.col("__new").isNotNull())
        pick = lambda c: F.when(F.col("__on"), F.col("__new")[c]).otherwise(F.col(c)).alias(c)
        olds = [F.col("__new")["old_" + c].alias("old_" + c) for c in names]
        before = self.base
        self.base, n = written_counted(merged.select("id", *(pick(c) for c in names), *olds, "__on"), "state", F.col("__on"))
        forget(before)
        return self.base.filter("__on").select("id", *names, *("old_" + c for c in names)), n

    def update(self, changed: DataFrame, n: int) -> None:
        rows = changed.select(*self.columns)
        if n == self.size:
            forget(self.base)
            self.base, self.patch, self.patched = written(rows, "state"), None, 0
            return
        if self.patch is not None:
            rows = self.patch.join(small_or_plain(changed.select("id"), n), "id", "left_anti").unionByName(rows)
        before = self.patch
        self.patch, self.patched = written_counted(rows, "patch")
        if before is not None:
            forget(before)
        if self.patched * 4 > self.size:
            base, patch = self.base, self.patch
            self.base, self.patch, self.patched = written(self.frame(), "state"), None, 0
            forget(base)
            forget(patch)


def _ends(edges: DataFrame, direction: Dir | Column) -> DataFrame:
    """Edges seen from a center, with ``__way``: 1 where they arrive, 2 where they leave."""
    view = lambda c, n, way: F.struct(F.col(c).alias("center"), F.col(n).alias("nbr"), F.lit(way).alias("__way"))
    views = [view("dst", "src", 1)] * (isinstance(direction, Column) or bool(direction & Dir.IN)) + [view("src", "dst", 2)] * (isinstance(direction, Column) or bool(direction & Dir.OUT))
    return edges.select("*", F.inline(F.array(*views)))


def save_snapshot(path: str, iteration: int, vertices: DataFrame, messages: DataFrame) -> None:
    folder = f"{path.rstrip('/')}/step-{iteration:06d}"
    vertices.write.mode("overwrite").parquet(f"{folder}/vertices")
    messages.write.mode("overwrite").parquet(f"{folder}/messages")  # last: a snapshot is whole if it has messages


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """(vertices, messages, iteration) of the last whole snapshot below ``path``, to go on from."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    at = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join([str(root), *parts]))
    steps = sorted(s.getPath().getName() for s in fs.listStatus(root))
    whole = [s for s in steps if s.startswith("step-") and fs.exists(at(s, "messages", "_SUCCESS"))]
    if not whole:
        raise FileNotFoundError(f"no snapshot below {path}")
    folder = f"{path.rstrip('/')}/{whole[-1]}"
    return spark.read.parquet(f"{folder}/vertices"), spark.read.parquet(f"{folder}/messages"), int(whole[-1][5:])


def run(
    graph: Graph,
    program: VertexProgram,
    messages: DataFrame | None = None,
    max_iterations: int | None = None,
    timeout: float | None = None,
    all_active: bool = False,
    aggregators: Mapping[str, Aggregator] | None = None,
    stop: Callable[[int, dict], bool] | None = None,
    engine: str = "synchronous",
    snapshot_interval: int = 0,
    snapshot_path: str | None = None,
    begin_at: int = 0,
    catch: bool = False,
    first: tuple[Column, int] | None = None,
) -> RunResult:
    """Run until no vertex is active, ``max_iterations``, ``timeout`` seconds, or ``stop(iteration, aggregates)``.

    messages: (id, msg), default one to every vertex. all_active: every vertex runs in every step, and nothing is
    scattered. engine: any of the known names; all run synchronously. A snapshot is written every ``snapshot_interval``
    steps; to go on from one, give its vertices, messages and iteration (``begin_at``). ``catch``: a failing step ends the
    run with the states before it and status EXCEPTION, instead of raising. ``first``: (order, n): only the n messages that
    come first in an order of ``msg`` and ``id`` are delivered in a step; the others wait and are combined with later ones.
    """
    if engine not in ("synchronous", "sync", "asynchronous", "async", "warp"):
        raise ValueError(f"unknown engine: {engine}")
    if snapshot_interval and not snapshot_path:
        raise ValueError("a snapshot needs a path")
    runner = _Runner(graph, program, messages, all_active, begin_at, first)
    began, seen = time.monotonic(), {k: [] for k in aggregators or {}}
    looked = dict.fromkeys(seen, began)

    def done(status: str, error: Exception | None = None) -> RunResult:
        return RunResult(Graph(runner.states.frame(), runner.edges), status, runner.iteration, runner.updates, seen, error)

    while True:
        if max_iterations is not None and runner.iteration >= max_iterations:
            return done("MAX_ITERATIONS")
        if timeout is not None and time.monotonic() - began > timeout:
            return done("TIMEOUT")
        try:
            runner.apply()
        except Exception as error:
            if not catch:
                raise
            return done("EXCEPTION", error)
        for k, a in (aggregators or {}).items():
            now = time.monotonic()
            if (now - looked[k] >= a.seconds) if a.seconds is not None else (a.every and runner.iteration % a.every == 0):
                seen[k].append(a.now(Graph(runner.states.frame(), runner.edges)))
                looked[k] = now
        if stop is not None and stop(runner.iteration, {k: v[-1] for k, v in seen.items() if v}):
            return done("FORCED_ABORT")
        if not all_active and not runner.scatter():
            return done("TASK_DEPLETION")
        if snapshot_interval and runner.iteration % snapshot_interval == 0:
            save_snapshot(snapshot_path, runner.iteration, runner.states.frame(), runner.inbox)


class _Runner:
    def __init__(self, graph: Graph, program: VertexProgram, messages: DataFrame | None, all_active: bool, begin_at: int, first: tuple[Column, int] | None) -> None:
        self.program, self.all_active = program, all_active
        # Written once: every step scans the edges, and they may be the result of joins.
        self.edges = written(graph.edges, "edges")
        self.names = [c for c in graph.vertices.columns if c != "id"]
        self.states = _States(graph.vertices)
        inbox = messages if messages is not None else signals(graph.complete_set())
        self.inbox, self.n_inbox = (None, 0) if all_active else self._combined(inbox)
        self.first, self.waiting = first, None
        self._choose()
        self.iteration, self.updates = begin_at, 0
        self.changed: DataFrame | None = None
        self.n_changed = 0
        ctx = ("ctx_num_vertices", "ctx_num_edges")
        used = _named("", list(ctx), [*program.apply.values(), program.scatter_if, program.message, *program.gather.values(), *program.edge_update.values()])
        self.context = {"ctx_num_vertices": F.lit(self.states.size).cast("long")}
        if ctx[1] in used:
            self.context["ctx_num_edges"] = F.lit(self.edges.count()).cast("long")

    def _combined(self, messages: DataFrame) -> tuple[DataFrame, int]:
        return written_counted(messages.groupBy("id").agg(self.program.combine(F.col("msg")).alias("msg")), "messages")

    def _choose(self) -> None:
        """Keep only the first messages of the inbox for the next step."""
        if self.first is None or self.n_inbox <= self.first[1]:
            self.waiting = None
            return
        whole = self.inbox
        self.inbox, self.n_inbox = written_counted(whole.orderBy(self.first[0], "id").limit(self.first[1]), "messages")
        self.waiting = whole.join(small_or_plain(self.inbox.select("id"), self.n_inbox), "id", "left_anti")

    def _literals(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.context | {"ctx_iteration": F.lit(self.iteration)})

    def apply(self) -> None:
        program, names = self.program, self.names
        if self.all_active:
            active, n = self.states.frame().withColumn("msg", F.lit(0.0)), self.states.size
        else:
            active, n = self.states.of(self.inbox, self.n_inbox), self.n_inbox
        active = self._literals(active)
        if program.init:
            active = active.withColumns(dict(program.init))
        if program.gather:
            exprs = [*program.gather.values(), program.gather_dir if isinstance(program.gather_dir, Column) else None]
            mine, theirs = _named("c_", names, exprs), _named("n_", names, exprs)
            center = active.select(F.col("id").alias("center"), *(F.col(c).alias("c_" + c) for c in mine))
            rows = _ends(self.edges, program.gather_dir).join(small_or_plain(center, n), "center")
            if isinstance(program.gather_dir, Column):
                rows = rows.filter(program.gather_dir.cast("int").bitwiseAND(F.col("__way")) > 0)
            if theirs:
                rows = rows.join(self.states.frame(*theirs).select(F.col("id").alias("nbr"), *(F.col(c).alias("n_" + c) for c in theirs)), "nbr")
            totals = self._literals(rows).groupBy(F.col("center").alias("id")).agg(*(x.alias("acc_" + k) for k, x in program.gather.items()))
            active = active.join(totals, "id", "left").na.fill(program.gather_default, ["acc_" + k for k in program.gather])
        values = [(program.apply[c] if c in program.apply else F.col(c)).alias(c) for c in names]
        applied = active.select("id", *(F.col(c).alias("old_" + c) for c in names), *values)
        if self.states.size <= BROADCAST_ROWS:
            changed, n_changed = self.states.replaced(applied, names)
        else:
            changed, n_changed = written_counted(applied, "changed")
            if n_changed:
                self.states.update(changed, n_changed)
            if self.changed is not None:
                forget(self.changed)
        self.changed, self.n_changed = changed, n_changed
        self.updates += n_changed
        self.iteration += 1

    def scatter(self) -> bool:
        """Whether any message is under way."""
        program, names = self.program, self.names
        if program.edge_update and program.scatter_dir != Dir.NONE:
            self._write_edges()
        if program.message is None or program.scatter_dir == Dir.NONE:
            return False
        exprs = [program.scatter_if, program.message]
        olds = ["old_" + c for c in names]
        mine, theirs = _named("c_", [*names, *olds], exprs), _named("n_", names, exprs)
        center = self.changed.select(F.col("id").alias("center"), *(F.col(c).alias("c_" + c) for c in mine))
        rows = _ends(self.edges, program.scatter_dir).join(small_or_plain(center, self.n_changed), "center")
        if theirs:
            rows = rows.join(self.states.frame(*theirs).select(F.col("id").alias("nbr"), *(F.col(c).alias("n_" + c) for c in theirs)), "nbr")
        rows = self._literals(rows)
        if program.scatter_if is not None:
            rows = rows.filter(program.scatter_if)
        before, sent = self.inbox, rows.select(F.col("nbr").alias("id"), program.message.alias("msg"))
        self.inbox, self.n_inbox = self._combined(sent if self.waiting is None else sent.unionByName(self.waiting))
        if self.waiting is None:
            forget(before)
        self._choose()
        return self.n_inbox > 0

    def _write_edges(self) -> None:
        """New values for the scatter edges of active vertices."""
        program, names = self.program, self.names
        kept = self.edges.columns
        for side, other, way in (("src", "dst", Dir.OUT), ("dst", "src", Dir.IN)):
            if not program.scatter_dir & way:
                continue
            center = self.changed.select(F.col("id").alias(side), F.lit(True).alias("__on"), *(F.col(c).alias("c_" + c) for c in [*names, *("old_" + c for c in names)]))
            rows = self.edges.join(small_or_plain(center, self.n_changed), side, "left")
            rows = rows.join(self.states.frame().select(F.col("id").alias(other), *(F.col(c).alias("n_" + c) for c in names)), other)
            rows = self._literals(rows).withColumns({c: F.when(F.col("__on"), x).otherwise(F.col(c)) for c, x in program.edge_update.items()})
            self.edges = rows.select(*kept)
        self.edges = written(self.edges, "edges")
