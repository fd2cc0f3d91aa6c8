"""Every operator as a query over graphs derived from the star-schema tables, and independent SQL for it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tileflow.functions import metrics, scalars
from tileflow.operators import federate, shares
from tileflow.operators.graph import Graph
from tileflow.operators.order import accumulated
from tileflow.plans import algorithms as alg
from tileflow.plans.components import components
from tileflow.plans.lineage import cut, shared_path
from tileflow.plans.supersteps import Engine, Kernel, converged, run
from tileflow.sources import derive, sinks, text
from tileflow.sources.text import reversed_too

Query = Callable[[SparkSession, str], DataFrame]

TILES, STEPS, RANK_STEPS, BOUNDARY = 3, 6, 5, 10_000_000

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.from_edges(derive.next_items(spark, sf_dir), F.pmod("id", F.lit(TILES)))


def _kept(spark: SparkSession, sf_dir: str) -> Graph:
    """The same graph with its edges written, for what reads them more than once."""
    return Graph.from_edges(cut(derive.next_items(spark, sf_dir)), F.pmod("id", F.lit(TILES)))


def _source(graph: Graph) -> int:
    return graph.edges.agg(F.min("src")).first()[0] or 0


# SQL parts

E = """e AS (
  SELECT a.l_partkey AS src, b.l_partkey AS dst, min(CAST(trunc(b.l_quantity) AS BIGINT)) AS weight
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber GROUP BY ALL
), v AS (SELECT id, CAST(id % 3 AS INTEGER) AS tile FROM (SELECT src AS id FROM e UNION SELECT dst FROM e))"""
T = E + """, t AS (SELECT e.*, CAST(src % 3 AS INTEGER) AS src_tile, CAST(dst % 3 AS INTEGER) AS dst_tile FROM e)"""
D = E + """, o AS (SELECT v.id, count(e.src) AS out_deg FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id),
i AS (SELECT v.id, count(e.dst) AS in_deg FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id)"""
POW2 = "CAST(CASE WHEN in_deg <= 1 THEN 1 ELSE pow(2, ceil(log2(in_deg))) END AS BIGINT)"


def _steps(start: str, step: str, n: int) -> str:
    """CTEs s0 to sn: start, and step with {p} for the table before."""
    return ", ".join([f"s0 AS ({start})", *[f"s{k} AS ({step.format(p=f's{k - 1}', k=k)})" for k in range(1, n + 1)]])


_PATH_STEP = """SELECT {{p}}.id,
  CASE WHEN m.dist IS NOT NULL AND ({{p}}.dist IS NULL OR m.dist < {{p}}.dist) THEN m.dist ELSE {{p}}.dist END AS dist,
  CASE WHEN m.dist IS NOT NULL AND ({{p}}.dist IS NULL OR m.dist < {{p}}.dist) THEN m.pred ELSE {{p}}.pred END AS pred
  FROM {{p}} LEFT JOIN (
    SELECT dst, dist, min(src) AS pred FROM (
      SELECT x.dst, x.src, q.dist + {length} AS dist, min(q.dist + {length}) OVER (PARTITION BY x.dst) AS least
      FROM {edges} x JOIN {{p}} q ON q.id = x.src WHERE q.dist IS NOT NULL) WHERE dist = least GROUP BY dst, dist
  ) m ON m.dst = {{p}}.id"""


def _paths(start: str, length: str, steps: int = STEPS, edges: str = "e", more: str = "") -> str:
    return f"WITH {E}{more}, " + _steps(f"SELECT id, CAST({start} AS BIGINT) AS dist, CAST(NULL AS BIGINT) AS pred FROM v", _PATH_STEP.format(length=length, edges=edges), steps)


_FROM_SOURCE = "CASE WHEN id = (SELECT min(src) FROM e) THEN 0 END"


def _ranks(value: str, steps: int, zero: str = "{p}.rank") -> str:
    step = "SELECT {p}.id, {p}.in_deg, {p}.out_deg, " + value.replace("ZERO", zero) + " AS rank FROM {p} LEFT JOIN (SELECT e.dst, sum(q.rank / greatest(q.out_deg, 1)) AS total FROM e JOIN {p} q ON q.id = e.src GROUP BY e.dst) m ON m.dst = {p}.id"
    return f"WITH {D}, " + _steps("SELECT i.id, in_deg, out_deg, CAST(1 AS DOUBLE) AS rank FROM i JOIN o ON o.id = i.id", step, steps)


DAMPED = "CASE WHEN total IS NULL THEN ZERO ELSE 0.85::DOUBLE * total + 0.15::DOUBLE END"

# Sources and set operations


@query(f"WITH {E} SELECT src, dst, weight FROM e")
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir).edges


@query(f"WITH {E} SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e")
def graph_edges_undirected(spark, sf_dir):
    return reversed_too(_graph(spark, sf_dir).edges)


@query(f"WITH {E} SELECT src, dst, weight FROM e")
def graph_edges_dedup(spark, sf_dir):
    edges = derive.next_items(spark, sf_dir)
    return Graph.from_edges(edges.union(edges)).without_repeats().edges


@query(f"WITH {E} SELECT id, tile FROM v")
def graph_vertices(spark, sf_dir):
    return _graph(spark, sf_dir).vertices


@query("""SELECT src, dst, count(*) AS weight FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst
FROM events WHERE event_type = 'purchase') WHERE dst IS NOT NULL GROUP BY ALL""")
def graph_user_next(spark, sf_dir):
    return derive.next_users(spark, sf_dir)


@query(f"WITH {T} SELECT src, dst, weight FROM t WHERE src_tile = 1")
def tile_edges_owned(spark, sf_dir):
    return _graph(spark, sf_dir).tile_edges(1).select("src", "dst", "weight")


@query(f"WITH {T} SELECT src, dst, weight, src_tile FROM t WHERE src_tile = dst_tile")
def tile_edges_local(spark, sf_dir):
    return _graph(spark, sf_dir).tiled_edges().where("src_tile = dst_tile").drop("dst_tile")


@query(f"WITH {T} SELECT * FROM t WHERE src_tile <> dst_tile")
def tile_edges_remote(spark, sf_dir):
    return _graph(spark, sf_dir).tiled_edges().where("src_tile <> dst_tile")


@query(f"WITH {T}, x AS (SELECT DISTINCT src_tile AS tile, dst AS vid FROM t) SELECT vid, tile FROM x WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.id = x.vid AND v.tile = x.tile)")
def remote_destinations(spark, sf_dir):
    g = _graph(spark, sf_dir)
    known = g.tiled_edges().select(F.col("src_tile").alias("tile"), F.col("dst").alias("vid")).distinct()
    return known.join(g.vertices.withColumnRenamed("id", "vid"), ["vid", "tile"], "left_anti")


# Degrees, tiles and mirrors


@query(f"WITH {D} SELECT * FROM o")
def out_degree(spark, sf_dir):
    return _graph(spark, sf_dir).out_degrees()


@query(f"WITH {D} SELECT * FROM i")
def in_degree(spark, sf_dir):
    return _graph(spark, sf_dir).in_degrees()


@query(f"WITH {T} SELECT v.id, count(t.dst) AS in_deg FROM v LEFT JOIN t ON t.dst = v.id AND src_tile = dst_tile GROUP BY v.id")
def in_degree_local(spark, sf_dir):
    return _graph(spark, sf_dir).local_in_degrees()


@query(f"WITH {D} SELECT in_deg, count(*) AS n FROM i GROUP BY in_deg")
def degree_histogram(spark, sf_dir):
    return _graph(spark, sf_dir).degree_histogram()


@query(f"WITH {D} SELECT id, in_deg, {POW2} AS padded_deg FROM i")
def padded_degree(spark, sf_dir):
    return _graph(spark, sf_dir).padded_degrees()


@query(f"WITH {D} SELECT id, in_deg, greatest(in_deg, 1) AS padded_deg FROM i")
def padded_degree_rotation(spark, sf_dir):
    return _graph(spark, sf_dir).padded_degrees(rotation=True)


@query(f"WITH {D} SELECT id AS src, id AS dst, CAST(-1 AS BIGINT) AS weight, unnest(range(in_deg + 1, {POW2} + 1)) AS slot, true AS is_dummy FROM i")
def dummy_rows(spark, sf_dir):
    return _graph(spark, sf_dir).dummy_edges()


@query(f"""WITH {T} SELECT v.tile, CAST(count(*) AS BIGINT) AS vertices, any_value(coalesce(x.n, 0)) AS edges, any_value(coalesce(m.n, 0)) AS mirrors FROM v
LEFT JOIN (SELECT src_tile, count(*) AS n FROM t GROUP BY 1) x ON x.src_tile = v.tile
LEFT JOIN (SELECT src_tile, count(DISTINCT dst) AS n FROM t WHERE src_tile <> dst_tile GROUP BY 1) m ON m.src_tile = v.tile GROUP BY v.tile""")
def tile_counts(spark, sf_dir):
    return _graph(spark, sf_dir).tile_counts()


@query(f"WITH {T} SELECT DISTINCT src_tile AS tile, dst AS vid, dst_tile AS master_tile FROM t WHERE src_tile <> dst_tile")
def mirror_vertices(spark, sf_dir):
    return _graph(spark, sf_dir).mirrors().drop("acc_deg")


@query(f"WITH {T} SELECT src_tile AS tile, dst AS vid, dst_tile AS master_tile, count(*) AS acc_deg FROM t WHERE src_tile <> dst_tile GROUP BY ALL")
def mirror_acc_degree(spark, sf_dir):
    return _graph(spark, sf_dir).mirrors()


@query(f"""WITH {T} SELECT *, row_number() OVER (PARTITION BY tile, master_tile ORDER BY vid) - 1 AS position
FROM (SELECT src_tile AS tile, dst AS vid, dst_tile AS master_tile, count(*) AS acc_deg FROM t WHERE src_tile <> dst_tile GROUP BY ALL)""")
def mirror_positions(spark, sf_dir):
    return _graph(spark, sf_dir).mirror_positions()


@query(f"WITH {T} SELECT src_tile, dst_tile, count(DISTINCT dst) AS mirrors FROM t WHERE src_tile <> dst_tile GROUP BY ALL")
def tile_connectivity(spark, sf_dir):
    return _graph(spark, sf_dir).connectivity()


@query(f"""WITH {T}, c AS (SELECT src_tile, dst_tile, count(DISTINCT dst) AS m FROM t WHERE src_tile <> dst_tile GROUP BY ALL)
SELECT least(src_tile, dst_tile) AS tile_a, greatest(src_tile, dst_tile) AS tile_b, CAST(sum(m) AS BIGINT) AS mirrors FROM c GROUP BY ALL""")
def tile_connectivity_folded(spark, sf_dir):
    return _graph(spark, sf_dir).connectivity(folded=True)


# Orders and positions


@query(f"WITH {E} SELECT src, dst, weight FROM e ORDER BY src, dst, weight")
def edges_sorted(spark, sf_dir):
    return _graph(spark, sf_dir).sorted_edges()


@query(f"WITH {D}, p AS (SELECT id, {POW2} AS padded_deg FROM i) SELECT *, row_number() OVER (ORDER BY padded_deg DESC, id) - 1 AS position FROM p")
def vertices_by_degree_position(spark, sf_dir):
    return _graph(spark, sf_dir).positions_by_degree()


@query(f"WITH {E} SELECT dst, src, weight FROM e QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src, weight) = 1")
def first_of_runs(spark, sf_dir):
    return _graph(spark, sf_dir).first_of_runs()


@query(f"WITH {E} SELECT id, tile, row_number() OVER (PARTITION BY tile ORDER BY id) - 1 AS label FROM v")
def tile_ordinals(spark, sf_dir):
    return _graph(spark, sf_dir).tile_ordinals()


# One step, taken apart: kernels of one step


def _at_mirrors(spark, sf_dir, **combine) -> DataFrame:
    """What each tile has combined for its mirrors before it sends: a step with the tiles as part of the destination."""
    e = _graph(spark, sf_dir).tiled_edges().where("src_tile <> dst_tile")
    return e.groupBy("src_tile", "dst").agg(*[c.alias(n) for n, c in combine.items()])


@query(f"WITH {E} SELECT dst, 1 + weight AS dist, src AS pred FROM e")
def scatter_sssp_once(spark, sf_dir):
    """The messages of a shortest-path step from vertices that are all one away."""
    kernel = alg.sssp(0)
    senders = _graph(spark, sf_dir).vertices.select("id", F.lit(1).cast("long").alias("dist"))
    sent = _graph(spark, sf_dir).edges.join(senders, F.col("src") == F.col("id")).where(kernel.valid(1))
    return sent.select("dst", kernel.scatter["m"].alias("m")).select("dst", "m.*")


@query(f"WITH {T} SELECT src_tile, dst, min(weight) AS least FROM t WHERE src_tile <> dst_tile GROUP BY ALL")
def premerge_min(spark, sf_dir):
    return _at_mirrors(spark, sf_dir, least=F.min("weight"))


@query(f"WITH {T} SELECT src_tile, dst, CAST(sum(weight) AS BIGINT) AS total, count(*) AS n FROM t WHERE src_tile <> dst_tile GROUP BY ALL")
def premerge_sum(spark, sf_dir):
    return _at_mirrors(spark, sf_dir, total=F.sum("weight"), n=F.count("*"))


@query(f"WITH {E} SELECT v.id, least(10, min(weight)) AS state, count(e.dst) = 0 AS is_dummy FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id")
def gather_min_once(spark, sf_dir):
    start = lambda g: g.vertices.select("id", F.lit(10).cast("long").alias("state"), F.lit(True).alias("is_dummy"))
    apply = {"state": F.least("state", "least"), "is_dummy": F.col("least").isNull()}
    return run(_kept(spark, sf_dir), Kernel("gather", start, {"w": F.col("weight")}, {"least": F.min("w")}, apply, max_iters=1))


@query(f"WITH {E} SELECT v.id, CAST(sum(weight) AS BIGINT) AS total, count(e.dst) AS n FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id")
def gather_sum_and_count(spark, sf_dir):
    start = lambda g: g.vertices.select("id", F.lit(None).cast("long").alias("total"), F.lit(0).cast("long").alias("n"))
    apply = {"total": F.col("sum_w"), "n": F.coalesce("n_w", F.lit(0)).cast("long")}
    return run(_kept(spark, sf_dir), Kernel("gather", start, {"w": F.col("weight")}, {"sum_w": F.sum("w"), "n_w": F.count("w")}, apply, max_iters=1))


# Algorithms


@query(_paths(_FROM_SOURCE, "x.weight") + f" SELECT id, dist FROM s{STEPS}")
def sssp_k(spark, sf_dir):
    return run(g := _kept(spark, sf_dir), alg.sssp(_source(g), STEPS)).select("id", "dist")


@query(_paths(_FROM_SOURCE, "x.weight") + f" SELECT id, dist, pred FROM s{STEPS}")
def sssp_pred_k(spark, sf_dir):
    return run(g := _kept(spark, sf_dir), alg.sssp(_source(g), STEPS)).select("id", "dist", "pred")


# To the end, however many steps that takes


def _finished(graph: Graph, kernel: Callable[[int], Kernel]) -> DataFrame:
    """The state that no step changes. A least value is handed on by one edge a step at least, so there are no more steps than vertices."""
    return run(graph, kernel(graph.vertices.count() + 1), until_converged=True)


_LEVELS = """h(id, hops) USING KEY (id) AS (SELECT min(src), 0 FROM e HAVING count(*) > 0
  UNION SELECT e.dst, min(h.hops) + 1 FROM h JOIN e ON e.src = h.id LEFT JOIN recurring.h s ON s.id = e.dst WHERE s.id IS NULL GROUP BY e.dst)"""


@query(f"""WITH RECURSIVE {E}, h(id, dist) USING KEY (id) AS (SELECT min(src), CAST(0 AS BIGINT) FROM e HAVING count(*) > 0
  UNION SELECT e.dst, min(h.dist + e.weight) FROM h JOIN e ON e.src = h.id LEFT JOIN recurring.h s ON s.id = e.dst WHERE s.id IS NULL OR h.dist + e.weight < s.dist GROUP BY e.dst)
SELECT v.id, h.dist FROM v LEFT JOIN h ON h.id = v.id""")
def sssp(spark, sf_dir):
    s = _source(g := _kept(spark, sf_dir))
    return _finished(g, lambda n: alg.sssp(s, n)).select("id", "dist")


@query(f"""WITH RECURSIVE {E}, {_LEVELS}, p AS (SELECT b.id, min(a.id) AS pred FROM h b JOIN e ON e.dst = b.id JOIN h a ON a.id = e.src AND a.hops + 1 = b.hops GROUP BY b.id)
SELECT v.id, CAST(CASE WHEN h.id IS NOT NULL THEN 0 END AS BIGINT) AS dist, p.pred FROM v LEFT JOIN h ON h.id = v.id LEFT JOIN p ON p.id = v.id""")
def bfs_reach(spark, sf_dir):
    s = _source(g := _kept(spark, sf_dir))
    return _finished(g, lambda n: alg.bfs_reach(s, n)).select("id", "dist", "pred")


@query(f"WITH RECURSIVE {E}, {_LEVELS} SELECT v.id, CAST(h.hops AS BIGINT) AS dist FROM v LEFT JOIN h ON h.id = v.id")
def bfs_hops(spark, sf_dir):
    s = _source(g := _kept(spark, sf_dir))
    return _finished(g, lambda n: alg.bfs_hops(s, n)).select("id", "dist")


#: Labels handed on along edges until nothing changes: start has (id, label).
_LABELS = """r(id, label) USING KEY (id) AS (SELECT id, label FROM start
  UNION SELECT x.dst, min(r.label) FROM r JOIN {edges} x ON x.src = r.id JOIN recurring.r s ON s.id = x.dst WHERE r.label < s.label GROUP BY x.dst)"""


@query(f"""WITH RECURSIVE {E}, start AS (SELECT id, id AS label FROM v), {_LABELS.format(edges="e")},
l AS (SELECT id, label FROM r), w AS (SELECT e.src, e.dst FROM e JOIN l a ON a.id = e.src JOIN l b ON b.id = e.dst AND b.label = a.label),
h(id, hops) USING KEY (id) AS (SELECT id, 0 FROM l WHERE id = label
  UNION SELECT w.dst, min(h.hops) + 1 FROM h JOIN w ON w.src = h.id LEFT JOIN recurring.h s ON s.id = w.dst WHERE s.id IS NULL GROUP BY w.dst),
p AS (SELECT b.id, min(a.id) AS pred FROM h b JOIN w ON w.dst = b.id JOIN h a ON a.id = w.src AND a.hops + 1 = b.hops GROUP BY b.id)
SELECT l.id, l.label, p.pred FROM l LEFT JOIN p ON p.id = l.id""")
def cc_directed(spark, sf_dir):
    return _finished(_kept(spark, sf_dir), alg.components).select("id", F.col("dist").alias("label"), "pred")


@query(f"""WITH RECURSIVE {E}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), start AS (SELECT id, id AS label FROM v), {_LABELS.format(edges="b")}
SELECT id, label FROM r""")
def cc_undirected(spark, sf_dir):
    return components(_kept(spark, sf_dir))


@query(f"""WITH RECURSIVE {E}, start AS (SELECT id, row_number() OVER (PARTITION BY tile ORDER BY id) - 1 AS label FROM v), {_LABELS.format(edges="e")}
SELECT id, CAST(label AS BIGINT) AS label FROM r""")
def cc_tile_ordinal(spark, sf_dir):
    return _finished(_kept(spark, sf_dir), alg.tile_components).select("id", F.col("dist").alias("label"))


def _rank(spark, sf_dir, mode, **more):
    return run(_kept(spark, sf_dir), alg.pagerank(mode, max_iters=RANK_STEPS, **more)).select("id", F.round(F.col("rank") + 1e-8, 6).alias("rank"))


_END = f" SELECT id, round(CASE WHEN in_deg = 0 THEN 0.15::DOUBLE ELSE rank END + 1e-8, 6) AS rank FROM s{RANK_STEPS}"


@query(_ranks(DAMPED, RANK_STEPS) + _END)
def pagerank_damped_k(spark, sf_dir):
    return _rank(spark, sf_dir, "damped")


@query(_ranks(DAMPED, RANK_STEPS, "0.15::DOUBLE") + _END)
def pagerank_damped_each(spark, sf_dir):
    return _rank(spark, sf_dir, "damped", zero_indeg="each")


@query(_ranks("CASE WHEN total IS NULL THEN ZERO ELSE total END", RANK_STEPS) + _END)
def pagerank_undamped_k(spark, sf_dir):
    return _rank(spark, sf_dir, "undamped")


@query(_ranks("{p}.rank + coalesce(total, 0)", RANK_STEPS) + f" SELECT id, round(rank + 1e-8, 6) AS rank FROM s{RANK_STEPS}")
def pagerank_accumulate_k(spark, sf_dir):
    return _rank(spark, sf_dir, "accumulate")


@query(f"WITH {D} SELECT id, 0.15::DOUBLE AS rank FROM i WHERE in_deg = 0")
def pagerank_zero_indeg(spark, sf_dir):
    return run(_kept(spark, sf_dir), alg.pagerank(max_iters=2)).where("in_deg = 0").select("id", F.round(F.col("rank") + 1e-8, 6).alias("rank"))


@query(_paths(_FROM_SOURCE, "1", 2) + " SELECT bool_and(a.dist IS NOT DISTINCT FROM b.dist) AS converged FROM s1 a JOIN s2 b ON a.id = b.id")
def converged_flag(spark, sf_dir):
    g = _kept(spark, sf_dir)
    s = _source(g)
    return converged([run(g, alg.bfs_hops(s, 1)), run(g, alg.bfs_hops(s, 2))], ["dist"])


@query(_paths(_FROM_SOURCE, "1", 4) + " " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS step, count(*) AS changed FROM s{k} a JOIN s{k - 1} b ON a.id = b.id WHERE a.dist IS DISTINCT FROM b.dist" for k in range(1, 5)))
def frontier_sizes(spark, sf_dir):
    g, trace = _kept(spark, sf_dir), []
    run(g, alg.bfs_hops(_source(g), 4), trace=trace)
    return spark.createDataFrame(trace, "step long, changed long")


@query(_paths("id", "0", 2) + " SELECT id, dist AS label FROM s2")
def kernels_in_sequence(spark, sf_dir):
    """A kernel that reads what another has left: the labels of one step, then one more step from there."""
    first = alg.components(1)
    second = replace(alg.components(1), name="again", init=lambda g: g.vertices)
    return Engine(_kept(spark, sf_dir)).add(first).add(second).run().select("id", F.col("dist").alias("label"))


# Matrix factors


def _ratings(spark, sf_dir):
    return Graph.from_edges(derive.supplier_parts(spark, sf_dir, BOUNDARY))


R = f"""r AS (SELECT l_partkey AS src, l_suppkey + {BOUNDARY} AS dst, CAST(round(avg(l_quantity)) AS BIGINT) AS weight FROM lineitem GROUP BY ALL),
b AS (SELECT * FROM r UNION ALL SELECT dst, src, weight FROM r)"""


@query(f"WITH {R} SELECT src AS id, avg(weight) AS mean FROM b WHERE src >= {BOUNDARY} GROUP BY src")
def als_init_avg(spark, sf_dir):
    return alg.als_start(_ratings(spark, sf_dir), BOUNDARY).where(F.col("id") >= BOUNDARY).select("id", F.col("f")[0].alias("mean"))


@query(f"""WITH {R}, f AS (SELECT DISTINCT src AS id, CAST(src % 5 AS DOUBLE) AS f0, CAST(src % 7 AS DOUBLE) AS f1 FROM b)
SELECT dst AS id, sum(weight * f0) AS b0, sum(weight * f1) AS b1, sum(f0 * f0) AS a0_0, sum(f0 * f1) AS a0_1, sum(f1 * f1) AS a1_1 FROM b JOIN f ON f.id = b.src WHERE src < {BOUNDARY} GROUP BY dst""")
def als_normal_eq(spark, sf_dir):
    scatter, combine = alg.als_normal_equations(2)
    e = reversed_too(_ratings(spark, sf_dir).edges).where(F.col("src") < BOUNDARY).withColumn("f", F.array((F.col("src") % 5).cast("double"), (F.col("src") % 7).cast("double")))
    return e.select("dst", *[c.alias(n) for n, c in scatter.items()]).groupBy(F.col("dst").alias("id")).agg(*[c.alias(n) for n, c in combine.items()])


@query(f"WITH {R} SELECT round(sum(pow(weight - ((src % 5) * (dst % 5) + (src % 7) * (dst % 7)), 2)), 3) AS error FROM r")
def als_sse(spark, sf_dir):
    g = _ratings(spark, sf_dir)
    f = g.vertices.select("id", F.array((F.col("id") % 5).cast("double"), (F.col("id") % 7).cast("double")).alias("f"))
    return alg.als_error(g, f).select(F.round("error", 3).alias("error"))


@query()
def als_factors(spark, sf_dir):
    g = _ratings(spark, sf_dir)
    return run(Graph.from_edges(cut(g.edges)), alg.als(BOUNDARY)).select("id", alg.role(F.col("id"), BOUNDARY).alias("role"), "f")


@query(f"WITH {R} SELECT src AS id, CASE WHEN src < {BOUNDARY} THEN 'USER' ELSE 'MOVIE' END AS role, count(*) AS ratings FROM b WHERE weight > 0.1 GROUP BY src")
def rating_counts(spark, sf_dir):
    b = reversed_too(_ratings(spark, sf_dir).edges).where("weight > 0.1")
    return b.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("ratings")).withColumn("role", alg.role(F.col("id"), BOUNDARY))


# Owners, messages and shares


@query(f"WITH {T} SELECT src_tile, dst_tile, count(*) AS messages, CAST((src_tile + 1) % 3 AS INTEGER) AS helper_tile FROM t WHERE src_tile <> dst_tile GROUP BY ALL")
def federated_messages(spark, sf_dir):
    return _graph(spark, sf_dir).messages().drop("merged")


@query(f"WITH {T} SELECT src_tile, dst_tile, count(DISTINCT dst) AS merged FROM t WHERE src_tile <> dst_tile GROUP BY ALL")
def federated_premerged_messages(spark, sf_dir):
    return _graph(spark, sf_dir).messages().select("src_tile", "dst_tile", "merged")


@query(_paths(_FROM_SOURCE, "x.weight", 2) + " SELECT id, dist, pred FROM s2")
def share_roundtrip(spark, sf_dir):
    g = _kept(spark, sf_dir)
    a, b = shares.split(run(g, alg.sssp(_source(g), 2)), ["dist", "pred"])
    return shares.reveal(*shares.share_again(a, b, seed=1))


@query(f"WITH {E} SELECT src + p * 100000000 AS src, dst + p * 100000000 AS dst, weight FROM e CROSS JOIN range(3) r(p)")
def fed_replicate(spark, sf_dir):
    return federate.replicate(_graph(spark, sf_dir), 3, 100_000_000).edges


def _synthesis(parties: int, ratio: float = 0.4, degree: int = 8, scale: str = "1") -> str:
    """CTEs of a federated graph: k the places of all vertices, d the edges kept, w a party's vertices, g the least distance of copies,
    x all edges. scale: "1", "sample" (every fifth vertex) or "extend" (two copies as one party)."""
    kept = {"1": "e", "sample": "(SELECT e.* FROM e JOIN k ON k.id = e.src AND k.place % 5 = 0)", "extend": "(SELECT src + i * m AS src, dst + i * m AS dst, weight FROM e, gap, range(2) r(i))"}[scale]
    ends = {"1": "SELECT id FROM k", "sample": "SELECT id FROM k WHERE place % 5 = 0 UNION SELECT dst FROM d", "extend": "SELECT id + i * m FROM k, gap, range(2) r(i)"}[scale]
    return f"""WITH {E}, k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM v), gap AS (SELECT max(id) + 1 AS m FROM v),
d AS (SELECT * FROM {kept}), w AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM ({ends}) q(id)), g AS (SELECT m * {2 if scale == "extend" else 1} AS stride FROM gap),
n AS (SELECT floor(floor(floor(count(*) * {parties} * {ratio}::DOUBLE) / {parties * (parties - 1)}) / {degree}) AS destinations FROM d),
x AS (SELECT CAST(src + p * stride AS BIGINT) AS src, CAST(dst + p * stride AS BIGINT) AS dst, weight FROM d, g, range({parties}) r(p) UNION ALL
  SELECT CAST(s.id + a.p * stride AS BIGINT), CAST(t.id + b.p * stride AS BIGINT), CAST(1 AS BIGINT) FROM w s, w t, n, g, range({parties}) a(p), range({parties}) b(p)
  WHERE s.place < {degree} AND t.place < n.destinations AND a.p <> b.p)"""


@query(f"""WITH {E}, p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v),
n AS (SELECT floor(floor(floor(count(*) * 3 * 0.4::DOUBLE) / 6) / 8) AS destinations FROM e)
SELECT s.id + a.p * 100000000 AS src, d.id + b.p * 100000000 AS dst, CAST(1 AS BIGINT) AS weight FROM p s, p d, n, range(3) a(p), range(3) b(p)
WHERE s.k < 8 AND d.k < n.destinations AND a.p <> b.p""")
def fed_inter_edges(spark, sf_dir):
    g = _kept(spark, sf_dir)
    return federate.inter_edges(g.vertices, 3, 100_000_000, 3 * g.edges.count(), 0.4)


@query(_synthesis(3) + " SELECT * FROM x")
def fed_synthesise(spark, sf_dir):
    return federate.synthesise(_kept(spark, sf_dir).edges, 3).edges


@query(_synthesis(4, scale="sample") + " SELECT * FROM x")
def fed_synthesise_sampled(spark, sf_dir):
    return federate.synthesise(_kept(spark, sf_dir).edges, 4, scale=0.2).edges


@query(_synthesis(2, 0.8, 4, "extend") + " SELECT * FROM x")
def fed_synthesise_extended(spark, sf_dir):
    return federate.synthesise(_kept(spark, sf_dir).edges, 2, 0.8, 2, 4).edges


@query(_synthesis(4, scale="sample") + " SELECT CAST(id + p * stride AS BIGINT) AS id, CAST(p AS INTEGER) AS tile FROM w, g, range(4) r(p)")
def fed_synthesise_vertices(spark, sf_dir):
    return federate.synthesise(_kept(spark, sf_dir).edges, 4, scale=0.2).vertices


@query(f"WITH {E}, p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v) SELECT e.* FROM e JOIN p ON p.id = e.src AND k % 5 = 0")
def fed_downsample(spark, sf_dir):
    return federate.downsample(_kept(spark, sf_dir).edges, 0.2)


@query(f"WITH {E} SELECT e.* FROM e WHERE src % 4 <> 3 AND dst % 4 <> 3")
def fed_unassigned_removed(spark, sf_dir):
    """A graph of which some vertices have no tile yet."""
    g = _graph(spark, sf_dir)
    tiles = F.when(F.col("id") % 4 == 3, F.lit(-1)).otherwise(F.col("id") % 4).cast("int")
    return Graph(g.vertices.withColumn("tile", tiles), g.edges).without_unassigned().edges


@query()
def fed_partition(spark, sf_dir):
    return federate.partition_edge_cut(_kept(spark, sf_dir).edges, 4)


@query("SELECT arg_min(s_nationkey, (s, s_nationkey)) AS tile FROM (SELECT s_nationkey, CAST(round(sum(s_acctbal)) AS BIGINT) AS s FROM supplier GROUP BY s_nationkey)")
def fed_least_loaded(spark, sf_dir):
    loads = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy(F.col("s_nationkey").alias("tile")).agg(F.round(F.sum("s_acctbal")).cast("long").alias("load"))
    return federate.least_loaded(loads)


# Text and measurements


@query(_paths(_FROM_SOURCE, "x.weight", 3) + " SELECT concat(id, chr(9), CASE WHEN dist IS NULL OR pred IS NULL THEN 'Can not reach <- none' ELSE concat(dist, ' ', chr(9), '<- ', pred) END) AS value FROM s3")
def text_sink_path_format(spark, sf_dir):
    v = run(g := _kept(spark, sf_dir), alg.sssp(_source(g), 3))
    return sinks.result_lines(v, sinks.path_text(F.col("dist"), F.col("pred"))).select("value")


@query("SELECT event_type AS tag, round(avg(value) * CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END, 6) AS mean, count(value) AS n FROM events GROUP BY event_type")
def metrics_mean(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("tag"), "value")
    return metrics.means(e, ["purchase"]).withColumn("mean", F.round("mean", 6))


@query("SELECT p_partkey AS id, CAST(floor(log2(p_size)) AS INTEGER) AS lg, pow(2, floor(log2(p_size))) = p_size AS is_pow2, CAST(pow(2, ceil(log2(p_size))) AS BIGINT) AS next FROM part")
def integer_functions(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = F.col("p_size").cast("long")
    return p.select(F.col("p_partkey").alias("id"), scalars.ilog2(n).alias("lg"), scalars.is_pow2(n).alias("is_pow2"), scalars.next_pow2(n).alias("next"))


# Layouts by position, and what is left of the tools


@query(f"""WITH {T} SELECT src_tile, dst_tile, row_number() OVER (PARTITION BY src_tile, dst_tile ORDER BY src, dst, weight) - 1 AS slot, dst, o.n AS out_deg
FROM t JOIN (SELECT src AS id, count(*) AS n FROM e GROUP BY src) o ON o.id = t.src""")
def state_on_edge_slots(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g.on_slots(g.out_degrees())


@query(f"""WITH {T}, m AS (SELECT src_tile, dst, min(weight) AS least FROM t WHERE src_tile <> dst_tile GROUP BY ALL), k AS (SELECT DISTINCT src_tile, dst_tile FROM t WHERE src_tile <> dst_tile)
SELECT k.src_tile, v.id, v.tile, m.least, m.dst IS NULL AS is_dummy FROM v JOIN k ON k.dst_tile = v.tile LEFT JOIN m ON m.src_tile = k.src_tile AND m.dst = v.id""")
def mirrors_to_masters(spark, sf_dir):
    g = _graph(spark, sf_dir)
    merged = g.tiled_edges().where("src_tile <> dst_tile").groupBy("src_tile", "dst").agg(F.min("weight").alias("least"))
    return g.from_mirrors(merged, ["least"])


@query(f"WITH {T} SELECT count(*) AS edges, CAST(count(*) FILTER (src_tile <> dst_tile) AS BIGINT) AS cut FROM t")
def edge_cut(spark, sf_dir):
    return _graph(spark, sf_dir).cut_edges()


@query(f"WITH {E} SELECT *, lead(src) OVER (PARTITION BY dst ORDER BY src, weight) IS NULL AS is_last FROM e")
def run_bounds(spark, sf_dir):
    return _graph(spark, sf_dir).run_bounds()


@query(f"WITH {E}, n AS (SELECT dst, count(*) AS updates, min(weight) AS least FROM e GROUP BY dst) SELECT dst, least, updates, CAST(ceil(log2(updates)) AS INTEGER) AS rounds FROM n")
def merge_rounds(spark, sf_dir):
    return _kept(spark, sf_dir).merged_in_pairs()


@query(f"WITH {D} SELECT max(in_deg) AS in_deg, max({POW2}) AS padded_deg FROM i")
def largest_degrees(spark, sf_dir):
    return _graph(spark, sf_dir).padded_degrees().agg(F.max("in_deg").alias("in_deg"), F.max("padded_deg").alias("padded_deg"))


@query("SELECT s_suppkey AS id, round(exp(0.0) / (exp(0.0) + exp((s_nationkey - 24) / 10.0)), 6) AS p, CAST(1 AS DOUBLE) AS total FROM supplier")
def softmax_and_running_sum(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.array(F.lit(2.4), F.col("s_nationkey") / 10.0).alias("a"))
    shares_of = x.select("id", scalars.softmax(F.col("a")).alias("parts"))
    return shares_of.select("id", F.round(F.col("parts")[0], 6).alias("p"), F.round(scalars.running_sum(F.col("parts"))[1], 6).alias("total"))


@query("""WITH m AS (SELECT user_id AS run, avg(value) FILTER (event_type = 'purchase') AS purchase, avg(value) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id)
SELECT run, round(coalesce(purchase, 0) + coalesce(view, 0), 6) AS total, round((purchase - view) / 20, 6) AS amortised FROM m""")
def metrics_amortised(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run"), F.col("event_type").alias("tag"), "value")
    wide = metrics.amortised(metrics.wide(e, ["purchase", "view"], {"total": ["purchase", "view"]}), "purchase", "view", 20)
    return wide.select("run", F.round("total", 6).alias("total"), F.round("amortised", 6).alias("amortised"))


@query("""SELECT s_suppkey AS id, s_nationkey AS nation, CAST(coalesce(sum(CAST(abs(trunc(s_acctbal)) AS BIGINT)) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM supplier""")
def running_totals(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.abs(F.col("s_acctbal").cast("long")).alias("x"))
    return accumulated(s, ["id"], "x", "before", ["nation"]).drop("x")


# Padding


@query(f"""WITH {T}, m AS (SELECT src_tile AS tile, dst, min(src) AS src, count(*) AS n FROM t WHERE src_tile <> dst_tile GROUP BY ALL)
SELECT src, dst, CAST(-1 AS BIGINT) AS weight, tile, unnest(range(n + 1, CAST(CASE WHEN n <= 1 THEN 1 ELSE pow(2, ceil(log2(n))) END AS BIGINT) + 1)) AS slot, true AS is_dummy FROM m""")
def mirror_dummy_rows(spark, sf_dir):
    return _graph(spark, sf_dir).mirror_dummies()


@query(_paths(_FROM_SOURCE, "x.weight") + f" SELECT id, dist, pred FROM s{STEPS}")
def sssp_padded_k(spark, sf_dir):
    """Shortest paths over padded edges, of which the dummies don't send: as without padding."""
    g = _kept(spark, sf_dir)
    kernel = alg.sssp(_source(g), STEPS)
    padded = replace(kernel, edges=lambda g: g.padded_edges(), valid=lambda step: ~F.col("is_dummy") & F.col("dist").isNotNull())
    return run(g, padded).select("id", "dist", "pred")


@query(f"""WITH {T}, m AS (SELECT src_tile, dst_tile, dst, count(*) AS n FROM t WHERE src_tile <> dst_tile GROUP BY ALL),
q AS (SELECT *, CAST(CASE WHEN n <= 1 THEN 1 ELSE pow(2, ceil(log2(n))) END AS BIGINT) AS padded FROM m),
c AS (SELECT src_tile, dst_tile, count(*) AS mirrors, CAST(sum(padded - 1) AS BIGINT) AS merges, max(padded) AS most FROM q GROUP BY ALL)
SELECT src_tile, dst_tile, 'premerge' AS phase, CAST(log2(most) AS INTEGER) AS rounds, merges AS messages, merges * 16 AS bytes FROM c
UNION ALL SELECT src_tile, dst_tile, unnest(['scatter', 'gather']), 1, mirrors, mirrors * 16 FROM c""")
def federated_traffic(spark, sf_dir):
    return _graph(spark, sf_dir).traffic()


# Files: written to the shared folder and read again


def _edge_file(spark, sf_dir, columns=("src", "dst", "weight"), separator=" ") -> str:
    path = shared_path(spark, "edges")
    sinks.write_edges(_graph(spark, sf_dir).edges.select(*columns), path, separator, header="src dst weight")
    return path


def _partition_file(spark, vertices: DataFrame) -> str:
    path = shared_path(spark, "partition")
    sinks.write_partition(vertices.select(F.col("id").alias("vid"), "tile"), path, "vertex tile")
    return path


@query(f"WITH {E} SELECT concat_ws(' ', src, dst, weight) AS value FROM e")
def text_effective_lines(spark, sf_dir):
    return text.effective_lines(spark, _edge_file(spark, sf_dir))


@query(f"WITH {E} SELECT src, dst, weight FROM e")
def text_edges(spark, sf_dir):
    return text.read_edges(spark, _edge_file(spark, sf_dir))


@query(f"WITH {E} SELECT src, dst, CAST(7 AS BIGINT) AS weight FROM e UNION ALL SELECT dst, src, 7 FROM e")
def text_edges_undirected_unweighted(spark, sf_dir):
    return text.read_edges(spark, _edge_file(spark, sf_dir, ("src", "dst")), default_weight=7, undirected=True)


@query(f"WITH {E} SELECT id AS vid, CAST((id % 6) // 2 AS INTEGER) AS tile FROM v")
def text_partition(spark, sf_dir):
    v = _graph(spark, sf_dir).vertices.withColumn("tile", F.pmod("id", F.lit(6)).cast("int"))
    return text.read_partition(spark, _partition_file(spark, v), 3, merge=2)


@query(f"WITH {E}, a AS (SELECT p_partkey AS id FROM part UNION SELECT id FROM v) SELECT a.id, CAST(a.id % 3 AS INTEGER) AS tile, count(e.dst) AS in_deg FROM a LEFT JOIN e ON e.dst = a.id GROUP BY a.id")
def text_partitioned_graph(spark, sf_dir):
    """A graph from an edge file and a partition file: all parts are vertices, isolated ones too."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"))
    v = parts.union(_graph(spark, sf_dir).vertices.select("id")).distinct().withColumn("tile", F.pmod("id", F.lit(TILES)).cast("int"))
    g = Graph.from_partition(text.read_edges(spark, _edge_file(spark, sf_dir)), text.read_partition(spark, _partition_file(spark, v), TILES)).freeze()
    return g.vertices.join(g.in_degrees(), "id")


@query(_paths(_FROM_SOURCE, "x.weight", 3) + " SELECT CAST(id % 3 AS INTEGER) AS tile, concat(id, chr(9), CASE WHEN dist IS NULL OR pred IS NULL THEN 'Can not reach <- none' ELSE concat(dist, ' ', chr(9), '<- ', pred) END) AS value FROM s3")
def text_results(spark, sf_dir):
    """A folder for each tile, read again."""
    v = run(g := _kept(spark, sf_dir), alg.sssp(_source(g), 3))
    path = shared_path(spark, "results")
    sinks.write_results(v, sinks.path_text(F.col("dist"), F.col("pred")), path)
    return spark.read.schema("value string, tile int").text(path).select("value", "tile")


@query(f"WITH {D} SELECT i.id, CAST(in_deg AS DOUBLE) / 4 AS rank, [CAST(in_deg AS DOUBLE), out_deg + 0.5::DOUBLE] AS f FROM i JOIN o ON o.id = i.id")
def text_ranks_and_vectors(spark, sf_dir):
    """Numbers and vectors written as text and read again as numbers."""
    v = _kept(spark, sf_dir).degrees().select("id", (F.col("in_deg") / 4).alias("rank"), F.array(F.col("in_deg").cast("double"), F.col("out_deg") + F.lit(0.5)).alias("f"))
    ranks, vectors = shared_path(spark, "ranks"), shared_path(spark, "vectors")
    sinks.write_results(v, sinks.rank_text(F.col("rank")), ranks)
    sinks.write_results(v, sinks.vector_text(F.col("f")), vectors)
    a, b = ([scalars.tokens(F.col("value"), "\t ").alias("t")] for _ in range(2))
    r = spark.read.text(ranks).select(*a).select(F.col("t")[0].cast("long").alias("id"), F.col("t")[1].cast("double").alias("rank"))
    return r.join(spark.read.text(vectors).select(*b).select(F.col("t")[0].cast("long").alias("id"), F.transform(F.slice("t", 2, 2), lambda x: x.cast("double")).alias("f")), "id")


@query(f"WITH {E} SELECT src, dst FROM e")
def csv_edges(spark, sf_dir):
    return text.read_csv_edges(spark, _edge_file(spark, sf_dir, separator=",,"))


@query(f"WITH {R} SELECT src AS \"user\", dst AS movie, CAST(weight AS DOUBLE) AS rating, dense_rank() OVER (ORDER BY src) - 1 AS user_index, dense_rank() OVER (ORDER BY dst) - 1 AS movie_index FROM r")
def text_ratings(spark, sf_dir):
    """A rating file, and dense indexes of its users and movies."""
    path = shared_path(spark, "ratings")
    sinks.write_edges(_ratings(spark, sf_dir).edges, path, "\t", header="user movie rating")
    return text.dense_ratings(text.read_ratings(spark, path))


@query("SELECT event_type AS tag, round(avg(value) * CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END, 6) AS mean, count(value) AS n FROM events GROUP BY event_type")
def metric_log(spark, sf_dir):
    path = shared_path(spark, "log")
    sinks.write_metrics(spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL").select(F.col("event_type").alias("tag"), "value"), path, ">>")
    return metrics.means(text.read_metrics(spark, path, ">>"), ["purchase"]).withColumn("mean", F.round("mean", 6))


@query("SELECT r_name AS section, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS position, [CAST(n_nationkey AS VARCHAR), n_name] AS cells FROM nation JOIN region ON r_regionkey = n_regionkey")
def figure_tables(spark, sf_dir):
    """A table file of a section for each region, a line for each of its nations."""
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    rows = n.select("n_regionkey", "n_nationkey", F.format_string("| %d | %s |", "n_nationkey", "n_name").alias("value"))
    heads = r.select("r_regionkey", F.lit(-1), F.concat(F.lit(">>>> "), "r_name"))
    path = shared_path(spark, "figures")
    rows.union(heads).coalesce(1).sortWithinPartitions("n_regionkey", "n_nationkey").select("value").write.text(path)
    found = text.read_sections(spark, path)
    return found.select("section", (F.row_number().over(Window.partitionBy("section").orderBy("position")) - 1).cast("long").alias("position"), "cells")


@query("SELECT s_name AS interface, s_acctbal AS download, row_number() OVER (ORDER BY s_acctbal DESC, s_name) - 1 AS position FROM supplier")
def interfaces_by_traffic(spark, sf_dir):
    return metrics.by_traffic(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("interface"), F.col("s_acctbal").alias("download")))


@query("""WITH m AS (SELECT user_id AS run, avg(value) FILTER (event_type = 'view') AS setup FROM events GROUP BY user_id) SELECT run, round(setup / 20 + 1, 6) AS setup FROM m""")
def metrics_rescaled(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run"), F.col("event_type").alias("tag"), "value")
    wide = metrics.wide(e, ["view"]).withColumnRenamed("view", "setup")
    return metrics.rescaled(wide, "setup", 20).select("run", F.round("setup", 6).alias("setup"))


@query(_paths(_FROM_SOURCE, "1", 3) + " " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS step, count(dist) AS reached FROM s{k}" for k in range(1, 4)))
def iteration_hook(spark, sf_dir):
    """What a hook sees after each step."""
    seen = []
    g = _kept(spark, sf_dir)
    run(g, replace(alg.bfs_hops(_source(g), 3), on_step=lambda step, state: seen.append((step, state.agg(F.count("dist")).first()[0]))))
    return spark.createDataFrame(seen, "step long, reached long")


@query(f"WITH {D} SELECT i.id, CAST(in_deg AS DOUBLE) / 8 + 0.3::DOUBLE AS x FROM i")
def share_roundtrip_doubles(spark, sf_dir):
    """Doubles shared in fixed point; those here have few enough binary places."""
    v = _kept(spark, sf_dir).in_degrees().select("id", shares.to_fixed(F.col("in_deg") / 8).alias("x"))
    back = shares.reveal(*shares.share_again(*shares.split(v, ["x"]), seed=2))
    return back.select("id", (shares.from_fixed(F.col("x")) + F.lit(0.3)).alias("x"))
