import pytest

from oracle import compare
from tileflow import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def test_als_reduces_the_error(spark):
    import numpy as np
    from tileflow.plans import algorithms as alg
    from tileflow.plans.supersteps import run

    g = queries._ratings(spark, SF)
    first = alg.als_error(g, alg.als_start(g, queries.BOUNDARY, 3)).first().error
    result = run(g, alg.als(queries.BOUNDARY, rank=3, max_iters=4)).persist()
    last = alg.als_error(g, result).first().error
    assert last < first / 10
    # one user solved by hand from the movies' features of the step before
    movies = run(g, alg.als(queries.BOUNDARY, rank=3, max_iters=3))
    f = {r.id: np.array(r.f) for r in movies.collect()}
    user = min(i for i in f if i < queries.BOUNDARY)
    rated = [(r.dst, r.weight) for r in g.edges.where(f"src = {user}").collect()]
    a = sum(np.outer(f[m], f[m]) for m, _ in rated) + 0.05 * len(rated) * np.eye(3)
    b = sum(w * f[m] for m, w in rated)
    assert np.allclose(result.where(f"id = {user}").first().f, np.linalg.solve(a, b))


def test_partition_is_balanced_and_cuts_less(spark):
    from pyspark.sql import functions as F

    edges = queries._graph(spark, SF).edges
    p = queries.QUERIES["fed_partition"](spark, SF).persist()
    n = p.count()
    assert n == queries._graph(spark, SF).vertices.count() == p.select("vid").distinct().count()
    loads = {r.tile: r["count"] for r in edges.join(p, edges.src == p.vid).groupBy("tile").count().collect()}
    total, most = edges.count(), edges.groupBy("src").count().agg(F.max("count")).first()[0]
    assert set(loads) <= {0, 1, 2, 3} and max(loads.values()) <= total * 1.05 / 4 + most

    def cut(part):
        a, b = part.select(F.col("vid").alias("src"), F.col("tile").alias("a")), part.select(F.col("vid").alias("dst"), F.col("tile").alias("b"))
        return edges.join(a, "src").join(b, "dst").where("a <> b").count()

    assert cut(p) <= cut(p.withColumn("tile", F.pmod(F.xxhash64("vid"), F.lit(4)).cast("int")))


@pytest.mark.parametrize("name", ["bfs_reach", "bfs_hops", "sssp"])
def test_searches_go_on_to_the_end(spark, name):
    import heapq

    edges = {}
    for r in queries._graph(spark, SF).edges.collect():
        edges.setdefault(r.src, []).append((r.dst, {"sssp": r.weight, "bfs_hops": 1, "bfs_reach": 0}[name]))
    heap, dist = [(0, min(edges))], {}
    while heap:
        d, v = heapq.heappop(heap)
        if v not in dist:
            dist[v] = d
            for w, x in edges.get(v, ()):
                heapq.heappush(heap, (d + x, w))
    assert {r.id: r.dist for r in queries.QUERIES[name](spark, SF).where("dist IS NOT NULL").collect()} == dist


def test_graphs_have_the_lines_of_every_flag(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").collect()
    at = {}
    for r in lines:
        at.setdefault((r.l_orderkey, r.l_linenumber), []).append((r.l_partkey, int(r.l_quantity)))
    least = {}
    for (order, n), here in at.items():
        for dst, w in at.get((order, n + 1), ()):
            for src, _ in here:
                least[src, dst] = min(w, least.get((src, dst), w))
    assert {(r.src, r.dst): r.weight for r in queries.QUERIES["graph_edges"](spark, SF).collect()} == least
    assert not [n for n, sql in queries.ORACLE_SQL.items() if "l_returnflag" in sql]


def test_factors_are_those_of_the_default_model(spark):
    from tileflow.plans import algorithms as alg

    got = queries.als_factors(spark, SF)
    assert {len(r.f) for r in got.collect()} == {5}
    g = queries._ratings(spark, SF)
    short = alg.als_error(g, queries.run(g, alg.als(queries.BOUNDARY, max_iters=4))).first().error
    assert alg.als_error(g, got.select("id", "f")).first().error < short
