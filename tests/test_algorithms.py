import pytest
from pyspark.sql import functions as F

from tileflow.operators import federate, shares
from tileflow.operators.graph import graph
from tileflow.functions import metrics, scalars
from tileflow.plans import algorithms as alg
from tileflow.plans.supersteps import Engine, Kernel, converged, run
from test_graph import SMALL, TILES, pairs


@pytest.fixture(scope="module")
def small(spark):
    return graph(spark, SMALL, TILES)


def paths(g, kernel, **options):
    return [tuple(r) for r in run(g, kernel, **options).orderBy("id").select("dist", "pred").collect()]


@pytest.mark.parametrize("k, expected", [(1, [(0, None), (1, 0), (None, None), (None, None)]), (2, [(0, None), (1, 0), (2, 1), (2, 1)]), (9, [(0, None), (1, 0), (2, 1), (2, 1)])])
def test_sssp(small, k, expected):
    assert paths(small, alg.sssp(0, k)) == expected


def test_reach_and_components(small):
    assert paths(small, alg.bfs_reach(0, 3)) == [(0, None), (0, 0), (0, 1), (0, 1)]
    assert paths(small, alg.components(1)) == [(0, None), (0, 0), (1, 1), (1, 1)]
    assert paths(small, alg.components(3)) == [(0, None), (0, 0), (0, 1), (0, 1)]


def test_convergence_stops_and_absent_source_reaches_nothing(small):
    trace = []
    run(small, alg.sssp(0, 50), until_converged=True, trace=trace)
    assert trace == [(1, 1), (2, 2), (3, 0)]
    assert paths(small, alg.sssp(77, 3)) == [(None, None)] * 4
    with pytest.raises(ValueError):
        run(small, Kernel("x", lambda g: g.vertices, {}, {}, {}), until_converged=True)


GOLD = {
    ("damped", 1): [1.425, 1.0, 0.575, 1.0],
    ("damped", 2): [1.244375, 1.36125, 0.575, 0.819375],
    ("damped", 10): [1.220424, 1.170365, 0.664401, 0.94481],
    ("undamped", 2): [1.25, 1.5, 0.5, 0.75],
    ("undamped", 10): [1.226562, 1.125, 0.664062, 0.984375],
    ("accumulate", 2): [5.25, 4.5, 2.5, 3.75],
    ("accumulate", 10): [1260.867188, 1260.1875, 629.851562, 945.09375],
}


@pytest.mark.parametrize("mode, k", list(GOLD))
def test_pagerank(small, mode, k):
    got = [r.rank for r in run(small, alg.pagerank(mode, max_iters=k)).orderBy("id").collect()]
    assert got == pytest.approx(GOLD[mode, k], abs=1e-6)


def test_vertex_without_in_edges(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 1)])
    ranks = lambda **kw: [round(r.rank, 6) for r in run(g, alg.pagerank(max_iters=2, **kw)).orderBy("id").collect()]
    assert ranks()[0] == 0.15 and ranks(zero_indeg="each")[0] == 0.15
    assert ranks()[1] > ranks(zero_indeg="each")[1]


def test_kernel_arguments():
    for bad in ({"beta": 0}, {"beta": 1.1}, {"mode": "other"}, {"max_iters": -1}):
        with pytest.raises(ValueError):
            alg.pagerank(**bad)


def test_engine_lists_and_drops_kernels(small):
    e = Engine(small).add(alg.components(1)).add(alg.sssp(0, 1))
    assert [k.name for k in e.kernels] == ["components", "sssp"]
    assert [k.name for k in e.remove("sssp").kernels] == ["components"]
    with pytest.raises(ValueError):
        e.remove("components").run()


def test_a_hub_is_dealt_out(spark):
    from tileflow.plans import supersteps

    g = graph(spark, [(0, k) for k in range(1, 200)] + [(k, 500) for k in range(1, 200)])
    placed, many = supersteps.place_edges(g.edges, slot_edges=20)
    assert pairs(many, "src", "slots") == [(0, 10)]
    state = supersteps.place_state(alg.sssp(0).init(g), many)
    for step in (1, 2):
        state = supersteps.superstep(placed, state, alg.sssp(0), step)
    assert state.where("id = 500").first().dist == 2 and state.where("dist = 1").count() == 199
    supersteps.release(placed, many)


def test_a_step_moves_messages_alone(spark, small):
    """Kept or cut, a state is read by the next step as it was dealt: the one exchange is that of the messages."""
    from tileflow.plans import lineage, supersteps

    kernel = alg.sssp(0)
    placed, many = supersteps.place_edges(small.edges)
    state = supersteps.place_state(kernel.init(small), many)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    with supersteps._as_planned(spark):
        first = supersteps.superstep(placed, state, kernel, 1)
        assert plan(first).count("Exchange hash") <= 1
        kept = lineage.cut(first)
        second = supersteps.superstep(placed, kept, kernel, 2)
        text = second._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(dst") == 1 and "Exchange hashpartitioning(id" not in text and text.count("Exchange") == 2  # the other one made the kept edges
    supersteps.release(placed, many)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


@pytest.mark.parametrize("cut_every", [1, 3])
def test_what_is_kept_is_let_go(spark, cut_every):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    line = graph(spark, [(k, k + 1) for k in range(9)])
    assert [r.dist for r in run(line, alg.sssp(0), until_converged=True, cut_every=cut_every).orderBy("id").collect()] == list(range(10))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_an_unfinished_run_is_an_error(spark):
    from tileflow.errors import NotConverged
    from tileflow.plans.components import components

    line = graph(spark, [(k, k + 1) for k in range(13)])
    with pytest.raises(NotConverged):
        run(line, alg.components(5, undirected=True), until_converged=True)
    assert {r.dist for r in run(line, alg.components(14, undirected=True), until_converged=True).collect()} == {0}
    assert {r.label for r in components(line).collect()} == {0}
    two = graph(spark, [(5, 3), (9, 9), (8, 4), (4, 8), (3, 7)])
    assert pairs(components(two), "id", "label") == [(3, 3), (4, 4), (5, 3), (7, 3), (8, 4), (9, 9)]
    assert components(graph(spark, [])).count() == 0


def test_hook_and_errors(spark):
    g = graph(spark, [(0, 100, 3), (1, 100, 5), (1, 101, 2)])
    errors = []
    run(g, alg.with_errors(alg.als(100, rank=1, max_iters=4), g, 2, errors))
    assert [k for k, _ in errors] == [2, 4] and errors[1][1] <= errors[0][1]
    f = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (100, [1.0]), (101, [3.0])], "id long, f array<double>")
    assert alg.als_error(g, f).first().error == (3 - 1) ** 2 + (5 - 2) ** 2 + (2 - 6) ** 2


def test_equations_without_one_solution():
    import numpy as np

    m = np.array([[[2.0, 0], [0, 4]], [[1, 1], [1, 1]]])
    assert np.allclose(alg._solve_all(m, np.array([[2.0, 4], [2, 2]])), [[1, 1], [1, 1]])


def test_weights_and_repeats_and_loops(spark):
    g = graph(spark, [(0, 1, 9), (0, 1, 2), (1, 1, 1), (0, 2, 5), (1, 2, 3)])
    assert paths(g, alg.sssp(0, 5)) == [(0, None), (2, 0), (5, 0)]


def test_converged(small):
    a, b = run(small, alg.sssp(0, 2)), run(small, alg.sssp(0, 3))
    assert converged([a, b], ["dist", "pred"]).first().converged
    assert not converged([run(small, alg.sssp(0, 1)), b], ["dist"]).first().converged


def test_shares(spark):
    v = spark.createDataFrame([(1, 5, None), (2, -(2**60), 2**60)], "id long, x long, y long")
    a, b = shares.split(v, ["x", "y"], seed=3)
    assert pairs(a, "x") != pairs(v, "x")
    assert pairs(shares.reveal(*shares.share_again(a, b, 9)).where("y IS NOT NULL"), "id", "x", "y") == [(2, -(2**60), 2**60)]
    fixed = spark.createDataFrame([(1.5,), (-0.25,)], "x double").select(shares.from_fixed(shares.to_fixed(F.col("x"))).alias("x"))
    assert pairs(fixed, "x") == [(-0.25,), (1.5,)]


def brute_synthesis(edges, parties, ratio, scale, degree):
    """Vertices in the order of their ids, as sets of destinations, sampled or laid side by side, copied and joined."""
    out = {v: set() for e in edges for v in e}
    for a, b in edges:
        out[a].add(b)
    stride = max(out) + 1
    order = sorted(out)
    if scale < 1:
        out = {v: out[v] for k, v in enumerate(order) if k % int(1 / scale) == 0}
    elif scale > 1:
        out = {v + stride * i: {d + stride * i for d in ds} for i in range(scale) for v, ds in out.items()}
        stride *= scale
    inside = [(a, b) for a, ds in out.items() for b in ds]
    vertices = sorted({*out, *(b for _, b in inside)})
    every = [(a + p * stride, b + p * stride) for p in range(parties) for a, b in inside]
    per_pair = int(int(len(every) * ratio) / (parties * (parties - 1)))
    for i in range(parties):
        for j in range(parties):
            if i != j:
                every += [(m + i * stride, k + j * stride) for k in vertices[: int(per_pair / degree)] for m in vertices[:degree]]
    return sorted(every), sorted((v + p * stride, p) for p in range(parties) for v in vertices)


@pytest.mark.parametrize("parties, ratio, scale, degree", [(2, 0.4, 1, 2), (3, 0.4, 1, 4), (4, 0.9, 1, 2), (3, 0.8, 0.34, 1), (4, 1.0, 0.5, 2), (2, 0.5, 3, 4)])
def test_federated_graphs(spark, parties, ratio, scale, degree):
    rows = [(k, (k * 7 + 3) % 31) for k in range(24)] + [(k, 40 + k % 5) for k in range(0, 24, 2)] + [(0, 3), (50, 1)]
    g = federate.synthesise(spark.createDataFrame(rows, "src long, dst long"), parties, ratio, scale, degree).check(parties)
    edges, vertices = brute_synthesis(rows, parties, ratio, scale, degree)
    assert pairs(g.edges, "src", "dst") == edges and pairs(g.vertices, "id", "tile") == vertices


def test_sampling_counts_sinks_too(spark):
    edges = spark.createDataFrame([(k, 100 - k) for k in range(10)], "src long, dst long")
    # vertices 0 to 9 and 91 to 100; of the sources alone 0, 3, 6 and 9 would be every third, too, but not with a sink before them
    assert pairs(federate.downsample(edges, 0.3), "src") == [(0,), (3,), (6,), (9,)]
    assert pairs(federate.downsample(edges.selectExpr("src + 50 AS src", "dst - 91 AS dst", "src % 5 AS w"), 0.3), "src", "dst") == [(52, 7), (55, 4), (58, 1)]
    assert federate.greedy_merge({(0, 1): 5.0, (1, 2): 1.0, (2, 3): 4.0}, 2) == [[0, 1], [2, 3]]
    for scale in (0, 1.5):
        with pytest.raises(ValueError):
            federate.downsample(edges, scale)


@pytest.mark.parametrize("parts, imbalance", [(1, 1.0), (3, 1.0), (4, 1.05), (5, 3.0)])
def test_partition_of_two_cliques(spark, parts, imbalance):
    rows = [(a + o, b + o) for o in (0, 100) for a in range(12) for b in range(12) if a != b] + [(0, 100)]
    p = dict(pairs(federate.partition_edge_cut(spark.createDataFrame(rows, "src long, dst long"), parts, imbalance), "vid", "tile"))
    assert set(p) == {v for e in rows for v in e} and set(p.values()) <= set(range(parts))
    load = [sum(p[a] == k for a, _ in rows) for k in range(parts)]
    assert max(load) <= len(rows) * imbalance / parts + 12


def test_unassigned_vertices_and_empty_partition(spark):
    v = spark.createDataFrame([(1, 0), (2, -1), (3, None), (4, 1)], "id long, tile int")
    e = spark.createDataFrame([(1, 4, 1), (1, 2, 1), (3, 4, 1)], "src long, dst long, weight long")
    from tileflow.operators.graph import Graph

    g = Graph(v, e).without_unassigned()
    assert pairs(g.vertices, "id") == [(1,), (4,)] and pairs(g.edges, "src", "dst") == [(1, 4)]
    assert federate.partition_edge_cut(e.limit(0), 3).count() == 0


def test_places_with_null_groups(spark):
    from tileflow.operators.order import accumulated, numbered

    rows = [("a", 1), (None, 7), (None, 5), ("b", 2), (None, None), ("a", 0)] + [("c", k) for k in range(60)]
    df = spark.createDataFrame(rows, "g string, x long")
    got = {(r.g, r.x): r.place for r in numbered(df, ["x"], "place", ["g"]).collect()}
    assert got == {("a", 0): 0, ("a", 1): 1, ("b", 2): 0, (None, None): 0, (None, 5): 1, (None, 7): 2, **{("c", k): k for k in range(60)}}
    assert sorted(r.place for r in numbered(df, ["x", "g"], "place").collect()) == list(range(66))
    sums = {(r.g, r.x): r.s for r in accumulated(df.where("x IS NOT NULL"), ["x"], "x", "s", ["g"]).collect()}
    assert sums["c", 59] == sum(range(59)) and sums[None, 7] == 5 and sums["b", 2] == 0


def test_scalars(spark):
    n = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 4, 5, 1023, 1024, 2**40 + 1)], "n long")
    got = [tuple(r) for r in n.select(scalars.next_pow2(F.col("n")), scalars.is_pow2(F.col("n")), scalars.ilog2(F.col("n"))).collect()]
    assert got == [(1, False, None), (1, True, 0), (2, True, 1), (4, False, 1), (4, True, 2), (8, False, 2), (1024, False, 9), (1024, True, 10), (2**41, False, 40)]
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))
    r = spark.range(1).select(scalars.inner(a, b).alias("i"), scalars.add(a, b).alias("s"), scalars.subtract(a, b).alias("d"), scalars.softmax(a).alias("p"), scalars.running_sum(a).alias("c"), scalars.tokens(F.lit("a,b;;c"), ",;").alias("t"), scalars.running_sum(F.array().cast("array<double>")).alias("z")).first()
    assert (r.i, r.s, r.d, r.c, r.t) == (11.0, [4.0, 6.0], [-2.0, -2.0], [1.0, 3.0], ["a", "b", "c"]) and r.z == []
    assert sum(r.p) == pytest.approx(1) and r.p[1] / r.p[0] == pytest.approx(2.718281828)
    draws = spark.range(200).select(scalars.int_draw(-5, 4, F.col("id")).alias("d"), scalars.unit_draw(F.col("id")).alias("u"))
    assert {x.d for x in draws.collect()} == set(range(-5, 5)) and all(0 <= x.u < 1 for x in draws.collect())


def test_metrics(spark):
    m = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", 4.0), ("b", "x", 8.0)], "run string, tag string, value double")
    assert pairs(metrics.means(m, ["x"]), "tag", "mean", "n") == [("x", 8.0, 3), ("y", 4.0, 1)]
    wide = metrics.wide(m, ["x", "y"], {"both": ["x", "y"]})
    assert pairs(wide, "run", "x", "both") == [("a", 2.0, 6.0), ("b", 8.0, 8.0)]
    assert pairs(metrics.amortised(wide, "both", "x", 2), "run", "amortised") == [("a", 2.0), ("b", 0.0)]
