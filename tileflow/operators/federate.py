"""Graphs for several owners: down-sampling, replication, edges between owners, and a balanced edge-cut partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileflow.functions.scalars import running_sum, unit_draw
from tileflow.operators.graph import Graph, endpoints
from tileflow.operators.order import accumulated, numbered
from tileflow.plans.lineage import cut, drop


def sample(vertices: DataFrame, scale: float) -> DataFrame:
    """id: every int(1 / scale)-th vertex by id, the first among them."""
    if not 0 < scale <= 1:
        raise ValueError("scale is not in (0, 1]")
    return numbered(vertices.select("id"), ["id"], "place").where(F.pmod("place", F.lit(int(1 / scale))) == 0).select("id")


def downsample(edges: DataFrame, scale: float) -> DataFrame:
    """The out-edges of every int(1 / scale)-th vertex by id, sinks counted too; their destinations stay whether sampled or not."""
    return edges.join(sample(endpoints(edges), scale).withColumnRenamed("id", "src"), "src", "left_semi").select(*edges.columns)


def extend(graph: Graph, copies: int, stride: int) -> Graph:
    """The graph so many times side by side, as one party's: the k-th copy's ids are moved up by k * stride; tiles stay as they are."""
    if copies < 1 or copies != int(copies):
        raise ValueError("copies is no whole number from 1 on")
    k = F.explode(F.sequence(F.lit(0), F.lit(int(copies) - 1))).alias("k")
    move = F.col("k").cast("long") * stride
    v = graph.vertices.select("id", "tile", k).select((F.col("id") + move).alias("id"), "tile")
    e = graph.edges.select("src", "dst", "weight", k).select((F.col("src") + move).alias("src"), (F.col("dst") + move).alias("dst"), "weight")
    return Graph(v, e)


def replicate(graph: Graph, parties: int, stride: int) -> Graph:
    """A copy of the graph for each party; party p's ids are moved up by p * stride and are its tile."""
    p = F.explode(F.sequence(F.lit(0), F.lit(parties - 1))).alias("p")
    move = F.col("p").cast("long") * stride
    v = graph.vertices.select("id", p).select((F.col("id") + move).alias("id"), F.col("p").cast("int").alias("tile"))
    e = graph.edges.select("src", "dst", "weight", p).select((F.col("src") + move).alias("src"), (F.col("dst") + move).alias("dst"), "weight")
    return Graph(v, e)


def inter_destinations(edges: int, parties: int, ratio: float, degree: int) -> int:
    """How many vertices of one party get edges from another: edges, all parties' copies together, times ratio, dealt over
    the ordered pairs of parties and by degree over destinations; each count is cut off to an integer."""
    return int(int(int(edges * ratio) / (parties * (parties - 1))) / degree) if parties > 1 else 0


def inter_edges(vertices: DataFrame, parties: int, stride: int, edges: int, ratio: float, degree: int = 8) -> DataFrame:
    """Edges from every party to every other: the first `degree` vertices of one to each of the first inter_destinations() of another."""
    destinations = inter_destinations(edges, parties, ratio, degree)
    v = numbered(vertices.select("id").distinct(), ["id"], "place")
    sources = v.where(F.col("place") < degree).select(F.col("id").alias("src"))
    if not destinations:
        return sources.select("src", F.col("src").alias("dst"), F.lit(1).cast("long").alias("weight")).limit(0)
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(parties) for b in range(parties) if a != b]))
    # degree sources only: a bounded side
    both = v.where(F.col("place") < destinations).select(F.col("id").alias("dst")).join(F.broadcast(sources), how="cross")
    moved = both.select("src", "dst", pairs.alias("p"))
    return moved.select((F.col("src") + F.col("p.a").cast("long") * stride).alias("src"), (F.col("dst") + F.col("p.b").cast("long") * stride).alias("dst"), F.lit(1).cast("long").alias("weight"))


def synthesise(edges: DataFrame, parties: int, ratio: float = 0.4, scale: float = 1.0, degree: int = 8) -> Graph:
    """A federated graph from an edge list: without repeats, sampled (scale below 1) or laid side by side (scale a whole
    number), copied for each party and joined by edges between them.

    A party's vertices are the sampled ones, isolated or not, and the ends of their edges. Copies are the whole list's largest id
    plus 1 apart, whatever was sampled. A repeated edge keeps its least weight, or 1 without weights.
    """
    weight = F.min("weight") if "weight" in edges.columns else F.lit(1).cast("long")
    distinct = edges.groupBy("src", "dst").agg(weight.alias("weight"))
    whole = endpoints(distinct)
    stride = (whole.agg(F.max("id")).first()[0] or 0) + 1
    if scale < 1:
        sampled = sample(whole, scale)
        distinct = distinct.join(sampled.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "weight")
        whole = sampled.union(endpoints(distinct)).distinct()
    one = Graph(whole.withColumn("tile", F.lit(0)), distinct)
    if scale > 1:
        one, stride = extend(one, scale, stride), stride * int(scale)
    every = replicate(one, parties, stride)
    n = one.edges.count() * parties
    return Graph(every.vertices, every.edges.unionByName(inter_edges(one.vertices, parties, stride, n, ratio, degree)))


def least_loaded(loads: DataFrame) -> DataFrame:
    """tile: the one with the least load of (tile, load), the smallest at a tie."""
    return loads.agg(F.min(F.struct("load", "tile")).alias("m")).select("m.tile")


def _choice(parts: int, loads: list[int], most: float, seed: int) -> Column:
    """The part that a vertex draws: by softmax over its scores (map score, part to number), weighted by the room that
    parts have left; the least loaded one if none has any."""
    room = [max(0.0, most - x) / most for x in loads]
    if not any(room):
        return F.lit(loads.index(min(loads)))
    x = F.array(*[F.coalesce(F.try_element_at("score", F.lit(p)), F.lit(0)).cast("double") for p in range(parts)])
    y = F.zip_with(F.transform(x, lambda v: F.exp(v - F.array_max(x))), F.array(*[F.lit(r) for r in room]), lambda e, w: e * w)
    sums = running_sum(y)
    total = F.element_at(sums, -1)
    # scores far below the largest vanish: if all with room do, the one with most room is taken
    drawn = F.size(F.filter(sums, lambda c: c < unit_draw(F.col("id"), seed=seed) * total))
    return F.when(total > 0, F.least(drawn, F.lit(parts - 1))).otherwise(F.lit(room.index(max(room))))


def partition_edge_cut(edges: DataFrame, parts: int, imbalance: float = 1.05, batches: int = 8, seed: int = 1115) -> DataFrame:
    """vid, tile: a partition balanced by edges that keeps a vertex's sources together.

    A part's load is the distinct out-edges of its vertices, at most imbalance times the mean (and the degree of the last
    vertex it took). A vertex scores a part by its destinations that already have a source there, as they share a mirror, and by
    whether the part already has an edge to it; it draws a part by softmax of the scores, weighted by the room left.

    One pass vertex by vertex would be one task: here vertices come in batches by a hash of their ids, and all of a batch see
    what the batches before left. Of those that wish for a part, a share by hash goes that its room allows, the others come
    again with the next batch; if that share is still too heavy, none of them goes. Whoever is left after the last
    batch fills the rooms in the order of ids. Draws are hashes, so the same edges give the same partition.
    """
    if parts < 1 or imbalance < 1:
        raise ValueError("parts or imbalance is below 1")
    out = cut(edges.select("src", "dst").distinct())
    degrees = out.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    every = cut(endpoints(out).join(degrees, "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(batches)).cast("int").alias("batch")))
    total = out.count()
    most = max(1.0, total * imbalance / parts)
    loads = [0] * parts
    done = cut(every.select("id", F.lit(None).cast("int").alias("tile")).limit(0))
    for b in range(batches):
        now = every.where(F.col("batch") <= b).join(done, "id", "left_anti")
        has = out.join(done, F.col("src") == F.col("id")).select(F.col("dst").alias("has"), "tile").distinct()
        by_ends = out.join(now, F.col("src") == F.col("id"), "left_semi").join(has, F.col("dst") == F.col("has")).select(F.col("src").alias("id"), "tile")
        scores = by_ends.union(has.select("has", "tile").join(now.select("id"), F.col("has") == F.col("id"), "left_semi")).groupBy("id", "tile").agg(F.count("*").alias("n"))
        tables = scores.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("tile", "n"))).alias("score"))  # an entry a part at most
        wishes = now.join(tables, "id", "left").withColumn("score", F.coalesce("score", F.create_map().cast("map<int,bigint>")))
        wishes = cut(wishes.select("id", "deg", _choice(parts, loads, most, seed + b).cast("int").alias("tile"), unit_draw(F.col("id"), F.lit(b), seed=seed).alias("draw")))
        asked = {r.tile: r.n for r in wishes.groupBy("tile").agg(F.sum("deg").alias("n")).collect()}  # a row a part
        share = {p: 1.0 if loads[p] + n <= most else 0.9 * max(0.0, most - loads[p]) / n for p, n in asked.items()}
        if not share:
            drop(wishes)
            continue
        going = wishes.where(F.col("draw") < F.create_map(*[F.lit(x) for p in share for x in (p, share[p])])[F.col("tile")])
        went = {r.tile: r.n for r in going.groupBy("tile").agg(F.sum("deg").alias("n")).collect()}
        full = [p for p, n in went.items() if loads[p] + n > most]
        going = going.where(~F.col("tile").isin(full)) if full else going
        loads = [x + (went.get(p, 0) if p not in full else 0) for p, x in enumerate(loads)]
        before, done = done, cut(done.union(going.select("id", "tile")))
        drop(wishes)
        drop(before)
    rest = every.join(done, "id", "left_anti").select("id", "deg")
    ends, so_far = [], 0.0
    for x in loads:
        so_far += max(0.0, most - x)
        ends.append(so_far)
    place = accumulated(rest, ["id"], "deg", "before")
    filled = place.select("id", F.least(F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("before"))), F.lit(parts - 1)).cast("int").alias("tile"))
    return done.union(filled).select(F.col("id").alias("vid"), "tile")


def greedy_merge(weights: dict[tuple[int, int], float], groups: int) -> list[list[int]]:
    """Parts merged pair by pair, the pair with the largest weight between them first, until so many groups are left. weights: of a few parts."""
    members = {p: [p] for pair in weights for p in pair}
    link = {frozenset(k): 0.0 for k in weights if k[0] != k[1]}
    for (a, b), w in weights.items():
        if a != b:
            link[frozenset((a, b))] += w
    while len(members) > max(1, groups) and link:
        best = max(link, key=lambda k: (link[k], [-x for x in sorted(k)]))
        keep, gone = sorted(best)
        members[keep] = sorted(members[keep] + members.pop(gone))
        merged: dict[frozenset, float] = {}
        for k, w in link.items():
            k = frozenset(keep if x == gone else x for x in k)
            if len(k) == 2:
                merged[k] = merged.get(k, 0.0) + w
        link = merged
    return [members[k] for k in sorted(members)]
