"""Gather-apply-scatter as a loop of join, group-by and join.

A kernel declares Column expressions; a superstep evaluates them for all edges and vertices at once, from the state
that the step before left. Edges are dealt and sorted by source, states by id, both over the same partitions, so a step
moves nothing but the combined messages, at most one a task and destination, and sorts nothing but these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.errors import NotConverged
from tileflow.operators.graph import Graph
from tileflow.plans.lineage import cut, drop

#: Edges of one source that stay together; a source with more is dealt out over several slots.
SLOT_EDGES = 100_000
#: Columns that a step adds to the state.
CHANGED, SLOTS = "changed_", "slots_"


@dataclass
class Kernel:
    """One algorithm. Scatter sees state columns of an edge's source, `id` (the source), `dst`, `weight`, further columns
    of the edges and `step`; apply sees the destination's state and the combined columns, null without a message, and `step`.

    init      graph -> vertices with state
    valid     which edges send
    scatter   message columns
    combine   aggregates over message columns; commutative and associative
    apply     new state columns
    finish    vertices after the last step -> result
    edges     graph -> the edges to send over, if not its own
    changed   over `old_<column>` and columns: whether a vertex's state is another
    frontier  only vertices that the step before changed send, all in the first: for kernels to which a message that was
              sent before says nothing new
    on_step   called with the step and the state after it
    """

    name: str
    init: Callable[[Graph], DataFrame]
    scatter: dict[str, Column]
    combine: dict[str, Column]
    apply: dict[str, Column]
    valid: Callable[[int], Column] = field(default=lambda step: F.lit(True))
    finish: Callable[[DataFrame], DataFrame] = field(default=lambda v: v)
    edges: Callable[[Graph], DataFrame] | None = None
    changed: Column | None = None
    frontier: bool = False
    on_step: Callable[[int, DataFrame], None] | None = None
    max_iters: int = 1000

    def __post_init__(self) -> None:
        if self.max_iters < 0:
            raise ValueError("max_iters is negative")
        if self.frontier and self.changed is None:
            raise ValueError(f"{self.name} has a frontier but can't tell whether a vertex has changed")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def _as_planned(spark: SparkSession) -> Iterator[None]:
    """Plans stay as they are made: how a kept table is dealt and sorted is then known to what reads it. Every join and
    group-by of the loop is over the same partitions, so there is nothing to adapt."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _kept(df: DataFrame) -> DataFrame:
    """df in a cache that is filled."""
    with _as_planned(df.sparkSession):
        df = df.persist()
        df.count()
    return df


def place_edges(edges: DataFrame, slot_edges: int = SLOT_EDGES) -> tuple[DataFrame, DataFrame | None]:
    """Edges dealt and sorted by (src, slot) and kept; and the sources of several slots with their number, None without any."""
    many = edges.groupBy("src").agg(F.ceil(F.count("*") / slot_edges).cast("int").alias("slots")).where("slots > 1")
    many = cut(many)
    n = _partitions(edges)
    if many.isEmpty():
        drop(many)
        return _kept(edges.repartition(n, "src").sortWithinPartitions("src")), None
    slots = edges.join(many, "src", "left").withColumn("slot", F.pmod(F.xxhash64("dst"), F.coalesce("slots", F.lit(1))).cast("int")).drop("slots")
    return _kept(slots.repartition(n, "src", "slot").sortWithinPartitions("src", "slot")), many


def place_state(state: DataFrame, many: DataFrame | None) -> DataFrame:
    """The state dealt and sorted by id, with what the steps need besides."""
    if many is not None:
        state = state.join(many.select(F.col("src").alias("id"), F.col("slots").alias(SLOTS)), "id", "left")
    return _kept(state.withColumn(CHANGED, F.lit(True)).repartition(_partitions(state), "id").sortWithinPartitions("id"))


def superstep(placed: DataFrame, state: DataFrame, kernel: Kernel, step: int) -> DataFrame:
    """The state after one more step; both as place_edges() and place_state() leave them."""
    now = F.lit(step)
    senders = state.where(CHANGED) if kernel.frontier else state
    senders = senders.drop(CHANGED).withColumn("step", now)
    at = placed.src == senders.id
    if SLOTS in state.columns:
        senders = senders.withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce(SLOTS, F.lit(1)) - 1))).drop(SLOTS)
        at = (placed.src == senders.id) & (placed.slot == senders.slot)
    sent = placed.join(senders.hint("merge"), at).where(kernel.valid(step))
    messages = sent.select("dst", *[c.alias(n) for n, c in kernel.scatter.items()])
    combined = messages.groupBy("dst").agg(*[c.alias(n) for n, c in kernel.combine.items()])
    both = state.withColumn("step", now).join(combined.hint("merge"), F.col("id") == F.col("dst"), "left")
    rest = [c for c in state.columns if c != CHANGED]
    old = [F.col(c).alias(f"old_{c}") for c in rest if c != "id"] if kernel.changed is not None else []
    after = both.select(*[kernel.apply[c].alias(c) if c in kernel.apply else F.col(c) for c in rest], *old)
    return after.select(*rest, (F.lit(True) if kernel.changed is None else kernel.changed).alias(CHANGED))


def release(placed: DataFrame, many: DataFrame | None) -> None:
    """Let go of what place_edges() has kept."""
    placed.unpersist()
    if many is not None:
        drop(many)


def run(graph: Graph, kernel: Kernel, until_converged: bool = False, cut_every: int = 4, trace: list | None = None, prepared: tuple[DataFrame, DataFrame | None] | None = None) -> DataFrame:
    """The kernel's result after max_iters steps, or with until_converged as soon as no state changes: if the last step
    still changes one, that raises NotConverged.

    trace, if given, gets (step, changed vertices) of every step. A state is kept until the next one is there, in memory
    or, each cut_every steps, in the checkpoint folder; nothing but the result is left there. prepared: the graph's own
    edges as place_edges() leaves them, for several runs; they are not let go of.
    """
    if (until_converged or trace is not None) and kernel.changed is None:
        raise ValueError(f"{kernel.name} can't tell whether a vertex has changed")
    own = prepared is None or kernel.edges is not None
    placed, many = place_edges(kernel.edges(graph) if kernel.edges is not None else graph.edges) if own else prepared
    first = kernel.init(graph)
    columns = first.columns
    state = place_state(first, many)
    n, base = 1, None
    for step in range(1, kernel.max_iters + 1):
        with _as_planned(state.sparkSession):
            after = superstep(placed, state, kernel, step)
            after = cut(after) if step % cut_every == 0 else after.persist()
            n = after.where(CHANGED).count()
        if state is not base:
            state.unpersist()
        if step % cut_every == 0:
            # what lost executors held is computed again from here
            if base is not None:
                drop(base)
            base = after
        state = after
        if kernel.on_step is not None:
            kernel.on_step(step, state.select(*columns))
        if trace is not None:
            trace.append((step, n))
        if not n and (until_converged or (kernel.frontier and trace is None and kernel.on_step is None)):
            break
    if until_converged and n and kernel.max_iters:
        raise NotConverged(f"{kernel.name}: {n} vertices still change in step {kernel.max_iters}")
    result = cut(kernel.finish(state.select(*columns)))
    state.unpersist()
    if base is not None:
        drop(base)
    if own:
        release(placed, many)
    return result


class Engine:
    """Runs kernels one after the other on the same graph; each gets the vertices that the one before left. Edges are dealt once."""

    def __init__(self, graph: Graph):
        self.graph = graph
        self.kernels: list[Kernel] = []

    def add(self, kernel: Kernel) -> Engine:
        self.kernels.append(kernel)
        return self

    def remove(self, name: str) -> Engine:
        self.kernels = [k for k in self.kernels if k.name != name]
        return self

    def run(self, **options) -> DataFrame:
        if not self.kernels:
            raise ValueError("no kernel to run")
        graph = self.graph
        prepared = place_edges(graph.edges)
        for k in self.kernels:
            result = run(graph, k, prepared=prepared, **options)
            graph = Graph(result, graph.edges)
        release(*prepared)
        return result


def converged(states: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """converged: whether two states agree in columns for every vertex."""
    a, b = states
    b = b.select("id", *[F.col(c).alias(f"other_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"other_{c}"))
    return a.join(b, "id").agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("converged"))
