"""The algorithms, each a kernel: shortest paths, reachability, hops, components, page ranks, matrix factors."""

from __future__ import annotations

from dataclasses import replace
from typing import Literal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileflow.functions.scalars import inner, int_draw, squared_norm, subtract
from tileflow.operators.graph import Graph
from tileflow.plans.supersteps import Kernel
from tileflow.sources.text import reversed_too


def _state(graph: Graph, **columns: Column) -> DataFrame:
    """Vertices with these state columns in the place of any of the same names."""
    return graph.vertices.select(*[c for c in graph.vertices.columns if c not in columns], *[e.alias(n) for n, e in columns.items()])


def _path_kernel(name: str, source: int | None, length: Column, max_iters: int) -> Kernel:
    """Least (distance, predecessor): the earliest step that reaches a distance decides, in it the smallest predecessor."""
    none = F.lit(None).cast("long")
    first = F.col("id") if source is None else F.when(F.col("id") == source, F.lit(0).cast("long"))
    better = F.col("best.dist").isNotNull() & (F.col("dist").isNull() | (F.col("best.dist") < F.col("dist")))
    return Kernel(
        name=name,
        init=lambda g: _state(g, dist=first.cast("long"), pred=none),
        valid=lambda step: F.col("dist").isNotNull(),
        scatter={"m": F.struct((F.col("dist") + length).alias("dist"), F.col("id").alias("pred"))},
        combine={"best": F.min("m")},
        apply={"dist": F.when(better, F.col("best.dist")).otherwise(F.col("dist")), "pred": F.when(better, F.col("best.pred")).otherwise(F.col("pred"))},
        changed=~F.col("dist").eqNullSafe(F.col("old_dist")) | ~F.col("pred").eqNullSafe(F.col("old_pred")),
        frontier=True,  # a distance that was sent before is no less than what has been taken
        max_iters=max_iters,
    )


def sssp(source: int, max_iters: int = 1000) -> Kernel:
    """Shortest distances of at most max_iters edges and predecessors; null where there is no path."""
    return _path_kernel("sssp", source, F.col("weight"), max_iters)


def bfs_reach(source: int, max_iters: int = 1000) -> Kernel:
    """Distance 0 for every vertex that is reached, and its predecessor."""
    return _path_kernel("bfs_reach", source, F.lit(0).cast("long"), max_iters)


def bfs_hops(source: int, max_iters: int = 1000) -> Kernel:
    """The number of edges from the source."""
    return _path_kernel("bfs_hops", source, F.lit(1).cast("long"), max_iters)


def components(max_iters: int = 1000, undirected: bool = False) -> Kernel:
    """The smallest id that reaches a vertex, in column dist; against the edges too if undirected (plans.components needs fewer steps for that)."""
    k = _path_kernel("components", None, F.lit(0).cast("long"), max_iters)
    if undirected:
        k.edges = lambda g: reversed_too(g.edges)
    return k


def tile_components(max_iters: int = 1000) -> Kernel:
    """As components, but labels begin as a vertex's place in its tile, so those of different tiles collide."""
    k = components(max_iters)
    k.init = lambda g: g.tile_ordinals().select("id", "tile", F.col("label").alias("dist"), F.lit(None).cast("long").alias("pred"))
    return k


def pagerank(mode: Literal["damped", "undamped", "accumulate"] = "damped", beta: float = 0.85, zero_indeg: Literal["end", "each"] = "end", max_iters: int = 1000, tolerance: float = 1e-4) -> Kernel:
    """rank, from 1.

    damped      beta * sum + 1 - beta of a vertex with in-edges; one without keeps 1 and gets 1 - beta at the end
                (zero_indeg="each": from the first step)
    undamped    sum, else as damped
    accumulate  rank + sum; nothing at the end
    tolerance   the change of a rank that counts where convergence is asked for
    """
    if not 0 < beta <= 1:
        raise ValueError("beta is not in (0, 1]")
    if mode not in ("damped", "undamped", "accumulate"):
        raise ValueError(f"no such mode: {mode}")
    total, rank, alone = F.col("total"), F.col("rank"), F.col("in_deg") == 0
    if mode == "accumulate":
        new = rank + F.coalesce(total, F.lit(0.0))
    else:
        new = F.when(total.isNull(), F.lit(1 - beta) if zero_indeg == "each" else rank).otherwise(beta * total + (1 - beta) if mode == "damped" else total)

    def finish(v: DataFrame) -> DataFrame:
        fixed = F.when(alone, F.lit(1 - beta)).otherwise(rank) if mode != "accumulate" else rank
        return v.withColumn("rank", fixed)

    return Kernel(
        name=f"pagerank_{mode}",
        init=lambda g: g.degrees().select("id", "tile", "in_deg", "out_deg", F.lit(1.0).alias("rank")),
        scatter={"share": rank / F.greatest(F.col("out_deg"), F.lit(1))},
        combine={"total": F.sum("share")},
        apply={"rank": new},
        finish=finish,
        changed=F.abs(rank - F.col("old_rank")) > tolerance,
        max_iters=max_iters,
    )


# Alternating least squares on a bipartite graph: users below boundary, movies from it on.


def role(vertex: Column, boundary: int) -> Column:
    return F.when(vertex < boundary, F.lit("USER")).otherwise(F.lit("MOVIE"))


def als_start(graph: Graph, boundary: int, rank: int = 5, seed: int = 0) -> DataFrame:
    """id, tile, in_deg, f: a movie's first feature is its mean rating; the others are drawn from -5 to 4 by id."""
    ratings = reversed_too(graph.edges)
    mean = ratings.groupBy(F.col("src").alias("id")).agg(F.avg("weight").alias("mean"), F.count("*").alias("in_deg"))
    v = graph.vertices.select("id", "tile").join(mean, "id", "left")
    draws = [int_draw(-5, 4, F.col("id"), F.lit(k), seed=seed).cast("double") for k in range(rank)]
    first = F.when(F.col("id") >= boundary, F.coalesce("mean", F.lit(0.0))).otherwise(draws[0])
    return v.select("id", "tile", F.coalesce("in_deg", F.lit(0)).alias("in_deg"), F.array(first, *draws[1:]).alias("f"))


def als_normal_equations(rank: int) -> tuple[dict[str, Column], dict[str, Column]]:
    """Message columns w * f and the upper half of f f', and their sums."""
    pairs = [(i, j) for i in range(rank) for j in range(i, rank)]
    scatter = {f"b{i}": F.col("weight") * F.col("f")[i] for i in range(rank)} | {f"a{i}_{j}": F.col("f")[i] * F.col("f")[j] for i, j in pairs}
    return scatter, {n: F.sum(n) for n in scatter}


def _solve_all(m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The solutions of a stack of equations; least squares for those without one (no lam, too few ratings)."""
    try:
        return np.linalg.solve(m, y[..., None])[..., 0]
    except np.linalg.LinAlgError:
        return np.stack([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(m, y, strict=True)])


def als(boundary: int = 10_000_000, rank: int = 5, lam: float = 0.05, tolerance: float = 1e-2, max_iters: int = 10, seed: int = 0) -> Kernel:
    """f: feature vectors; users are sent to in even steps, movies in odd ones, each solved with lam * degree added to the diagonal."""
    if lam < 0 or rank < 1:
        raise ValueError("lam is negative or rank below 1")
    scatter, combine = als_normal_equations(rank)
    pairs = [(i, j) for i in range(rank) for j in range(i, rank)]

    @F.pandas_udf("array<double>")
    def solve(b: pd.Series, a: pd.Series, n: pd.Series) -> pd.Series:
        got = b.notna().to_numpy()
        out = np.empty(len(b), object)
        if got.any():
            half, m = np.stack(a[got].to_list()), np.zeros((got.sum(), rank, rank))
            for k, (i, j) in enumerate(pairs):
                m[:, i, j] = m[:, j, i] = half[:, k]
            m += lam * n[got].to_numpy(float)[:, None, None] * np.eye(rank)
            solved = _solve_all(m, np.stack(b[got].to_list()).astype(float))
            out[np.flatnonzero(got)] = [*solved]
        return pd.Series(out)

    sent = F.col("b0").isNotNull()  # only vertices with messages are solved for
    new = solve(F.when(sent, F.array(*[F.col(f"b{i}") for i in range(rank)])), F.when(sent, F.array(*[F.col(f"a{i}_{j}") for i, j in pairs])), F.col("in_deg"))
    return Kernel(
        name="als",
        init=lambda g: als_start(g, boundary, rank, seed),
        edges=lambda g: reversed_too(g.edges),
        valid=lambda step: F.col("id") < boundary if step % 2 else F.col("id") >= boundary,
        scatter=scatter,
        combine=combine,
        apply={"f": F.coalesce(new, F.col("f"))},
        changed=squared_norm(subtract(F.col("f"), F.col("old_f"))) >= tolerance * tolerance,
        max_iters=max_iters,
    )


def als_error(graph: Graph, features: DataFrame) -> DataFrame:
    """error: the squared differences between known ratings, an edge each, and the products of features."""
    u = features.select(F.col("id").alias("src"), F.col("f").alias("fu"))
    m = features.select(F.col("id").alias("dst"), F.col("f").alias("fm"))
    both = graph.edges.join(u, "src").join(m, "dst")
    return both.agg(F.sum(F.pow(F.col("weight") - inner(F.col("fu"), F.col("fm")), 2)).alias("error"))


def with_errors(kernel: Kernel, graph: Graph, every: int, errors: list[tuple[int, float]]) -> Kernel:
    """The kernel, which adds (step, als_error) to errors after each so many steps."""

    def note(step: int, state: DataFrame) -> None:
        if every and step % every == 0:
            errors.append((step, als_error(graph, state).first().error))

    return replace(kernel, on_step=note)
