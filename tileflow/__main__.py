"""Command line: run an algorithm on an edge list, make or cut federated graphs, format edges, summarise logs.

    python -m tileflow sssp edges.txt --partition parts.txt --tiles 2 --iterations 10 --source 0 --out result
    python -m tileflow synthesise edges.txt --parties 3 --ratio 0.4 --out folder
    python -m tileflow partition edges.txt --parties 4 --out folder
    python -m tileflow format edges.csv --out folder
    python -m tileflow metrics run.log --double Scatter Gather
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tileflow.errors import GraphError
from tileflow.functions import metrics
from tileflow.operators import federate
from tileflow.operators.graph import Graph
from tileflow.plans import algorithms as alg
from tileflow.plans.lineage import cut
from tileflow.plans.supersteps import Kernel, run
from tileflow.sources import sinks, text

ALGORITHMS = ("sssp", "bfs", "hops", "cc", "pagerank", "als")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tileflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)
    for name in ALGORITHMS:
        c = commands.add_parser(name)
        c.add_argument("edges")
        c.add_argument("--partition", help="file of `vertex tile` lines; needed with several tiles")
        c.add_argument("--tiles", type=int, default=1)
        c.add_argument("--merge", type=int, default=1, help="so many neighbouring tiles are one")
        c.add_argument("--iterations", type=int, default=1000)
        c.add_argument("--weight", type=int, default=1, help="of edges without one")
        c.add_argument("--undirected", action="store_true")
        c.add_argument("--until-converged", action="store_true")
        c.add_argument("--lenient", action="store_true", help="vertices without a tile get tile 0")
        c.add_argument("--out")
        if name in ("sssp", "bfs", "hops"):
            c.add_argument("--source", type=int, default=0)
        if name == "pagerank":
            c.add_argument("--beta", type=float, default=0.85)
            c.add_argument("--tolerance", type=float, default=1e-4)
            c.add_argument("--mode", choices=("damped", "undamped", "accumulate"), default="damped")
        if name == "als":
            c.add_argument("--boundary", type=int, default=10_000_000)
            c.add_argument("--rank", type=int, default=5)
            c.add_argument("--lambda", dest="lam", type=float, default=0.05)
            c.add_argument("--error-every", type=int, default=0, help="print the error after each so many steps")
            c.add_argument("--tolerance", type=float, default=1e-2)
    for name in ("synthesise", "partition"):
        c = commands.add_parser(name)
        c.add_argument("edges")
        c.add_argument("--parties", type=int, default=2)
        c.add_argument("--out", required=True)
        if name == "synthesise":
            c.add_argument("--ratio", type=float, default=0.4)
            c.add_argument("--scale", type=float, default=0.2)
            c.add_argument("--degree", type=int, default=8)
        else:
            c.add_argument("--imbalance", type=float, default=1.05)
            c.add_argument("--seed", type=int, default=1115)
    c = commands.add_parser("format")
    c.add_argument("edges")
    c.add_argument("--out", required=True)
    c = commands.add_parser("metrics")
    c.add_argument("log")
    c.add_argument("--marker", default="::")
    c.add_argument("--double", nargs="*", default=[], help="tags that count twice")
    return p


def kernel(a: argparse.Namespace) -> Kernel:
    if a.command == "pagerank":
        return alg.pagerank(a.mode, a.beta, max_iters=a.iterations, tolerance=a.tolerance)
    if a.command == "als":
        return alg.als(a.boundary, a.rank, a.lam, a.tolerance, a.iterations)
    if a.command == "cc":
        return alg.components(a.iterations)
    return {"sssp": alg.sssp, "bfs": alg.bfs_reach, "hops": alg.bfs_hops}[a.command](a.source, a.iterations)


def load(spark: SparkSession, a: argparse.Namespace) -> Graph:
    if a.tiles != 1 and not a.partition:
        raise GraphError("several tiles need a partition file")
    edges = cut(text.read_edges(spark, a.edges, a.weight, a.undirected))
    if not a.partition:
        return Graph.from_edges(edges)
    return Graph.from_partition(edges, text.read_partition(spark, a.partition, a.tiles, a.merge), a.lenient)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tileflow").getOrCreate()
    try:
        if a.command in ALGORITHMS:
            graph, errors = load(spark, a), []
            k = kernel(a)
            if a.command == "als":
                k = alg.with_errors(k, graph, a.error_every, errors)
            result = run(graph, k, until_converged=a.until_converged)
            for step, error in errors:
                print(f"step {step}: error {error}")
            payload = sinks.rank_text(F.col("rank")) if a.command == "pagerank" else sinks.vector_text(F.col("f")) if a.command == "als" else sinks.path_text(F.col("dist"), F.col("pred"))
            if a.out:
                sinks.write_results(result, payload, a.out)
            else:
                result.write.format("noop").mode("overwrite").save()
        elif a.command == "synthesise":
            g = federate.synthesise(cut(text.read_edges(spark, a.edges)), a.parties, a.ratio, a.scale, a.degree)
            sinks.write_edges(g.edges, f"{a.out}/edges", header=f"{a.parties} parties")
            sinks.write_partition(g.vertices.select(F.col("id").alias("vid"), "tile"), f"{a.out}/partition", f"{a.parties} partitions")
        elif a.command == "partition":
            sinks.write_partition(federate.partition_edge_cut(cut(text.read_edges(spark, a.edges)), a.parties, a.imbalance, seed=a.seed), a.out, f"{a.parties} partitions")
        elif a.command == "format":
            sinks.write_edges(text.read_csv_edges(spark, a.edges), a.out)
        else:
            for r in metrics.means(text.read_metrics(spark, a.log, a.marker), a.double).orderBy("tag").toLocalIterator():
                print(f"{r.tag}\t{r.mean}\t{r.n}")
    except (GraphError, ValueError) as e:
        print(f"tileflow: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
