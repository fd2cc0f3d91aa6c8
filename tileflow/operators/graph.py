"""A graph as two DataFrames and what can be counted, joined and ordered on them.

vertices: id long, tile int; edges: src long, dst long, weight long. An edge belongs to its source's tile; a vertex
that a tile only knows as a destination is its mirror there.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.errors import DuplicateKey, Frozen, NotFound, OutOfRange
from tileflow.functions.scalars import next_pow2
from tileflow.operators.order import numbered
from tileflow.plans.lineage import cut, drop
from tileflow.sources.text import reversed_too


def endpoints(edges: DataFrame) -> DataFrame:
    """The distinct ids at either end."""
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    tile: Column | None = None  # over id, where a vertex's tile follows from its id: edges then get theirs without a join
    frozen: bool = False

    @staticmethod
    def from_edges(edges: DataFrame, tile: Column | None = None, undirected: bool = False, default_weight: int = 1) -> Graph:
        """Vertices are the ends of edges; tile is an expression of id (all in tile 0 without)."""
        if "weight" not in edges.columns:
            edges = edges.withColumn("weight", F.lit(default_weight).cast("long"))
        edges = edges.select("src", "dst", "weight")
        edges = reversed_too(edges) if undirected else edges
        tile = (F.lit(0) if tile is None else tile).cast("int")
        return Graph(endpoints(edges).withColumn("tile", tile), edges, tile)

    @staticmethod
    def from_partition(edges: DataFrame, partition: DataFrame, lenient: bool = False) -> Graph:
        """Vertices are the rows of partition (vid, tile), isolated ones too. An edge's end that isn't there raises, or lenient: gets tile 0."""
        vertices = partition.select(F.col("vid").alias("id"), F.col("tile").cast("int").alias("tile"))
        missing = endpoints(edges).join(vertices, "id", "left_anti")
        if lenient:
            vertices = vertices.union(missing.select("id", F.lit(0)))
        elif (first := missing.first()) is not None:
            raise NotFound(f"an edge's end has no tile: {first.id}")
        return Graph(vertices, edges)

    def check(self, tiles: int | None = None) -> Graph:
        """Raise for a repeated vertex, an edge without a vertex at either end, or tiles that aren't 0, 1, ... without gaps."""
        if (twice := self.vertices.groupBy("id").count().where("count > 1").first()) is not None:
            raise DuplicateKey(f"a vertex twice: {twice.id}")
        if (lost := endpoints(self.edges).join(self.vertices, "id", "left_anti").first()) is not None:
            raise NotFound(f"an edge's end is no vertex: {lost.id}")
        least, most, n = self.vertices.agg(F.min("tile"), F.max("tile"), F.countDistinct("tile")).first()
        if n and (least != 0 or most != n - 1 or (tiles is not None and most >= tiles)):
            raise OutOfRange(f"tiles from {least} to {most}, {n} of them")
        return self

    def freeze(self) -> Graph:
        """The graph, checked and finished: it takes no further vertices or edges."""
        return replace(self.check(), frozen=True)

    def _open(self) -> None:
        if self.frozen:
            raise Frozen("the graph is finished")

    def add_vertices(self, rows: DataFrame) -> Graph:
        self._open()
        return Graph(self.vertices.unionByName(rows.select("id", "tile")), self.edges)

    def add_edges(self, rows: DataFrame) -> Graph:
        self._open()
        return replace(self, edges=self.edges.unionByName(rows.select("src", "dst", "weight")))

    def without_repeats(self) -> Graph:
        """The least weight stands for edges with the same ends."""
        return replace(self, edges=self.edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")))

    def without_unassigned(self) -> Graph:
        """Without the vertices that have no tile (null or below 0) and the edges at them."""
        kept = self.vertices.where("tile >= 0")
        ids = kept.select("id")
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(kept, edges.select(*self.edges.columns))

    def tiled_edges(self) -> DataFrame:
        """Edges with the tiles of both ends."""
        if self.tile is not None:
            with_src = self.edges.withColumn("id", F.col("src")).withColumn("src_tile", self.tile)
            return with_src.withColumn("id", F.col("dst")).withColumn("dst_tile", self.tile).select("src", "dst", "weight", "src_tile", "dst_tile")
        v = self.vertices
        src = v.select(F.col("id").alias("src"), F.col("tile").alias("src_tile"))
        dst = v.select(F.col("id").alias("dst"), F.col("tile").alias("dst_tile"))
        return self.edges.join(src, "src").join(dst, "dst").select("src", "dst", "weight", "src_tile", "dst_tile")

    def tile_edges(self, tile: int) -> DataFrame:
        """The edges that a tile's owner loads: those that start there."""
        return self.tiled_edges().where(F.col("src_tile") == tile)

    # counts

    def out_degrees(self) -> DataFrame:
        """id, out_deg of every vertex, zeros too."""
        return self._degrees("src", "out_deg")

    def in_degrees(self) -> DataFrame:
        """id, in_deg of every vertex over all tiles' edges, zeros too."""
        return self._degrees("dst", "in_deg")

    def _degrees(self, end: str, name: str) -> DataFrame:
        n = self.edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name))
        return self.vertices.select("id").join(n, "id", "left").select("id", F.coalesce(name, F.lit(0)).cast("long").alias(name))

    def local_in_degrees(self) -> DataFrame:
        """id, in_deg by the edges of a vertex's own tile alone."""
        e = self.tiled_edges().where("src_tile = dst_tile")
        n = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_deg"))
        return self.vertices.select("id").join(n, "id", "left").select("id", F.coalesce("in_deg", F.lit(0)).cast("long").alias("in_deg"))

    def degrees(self) -> DataFrame:
        return self.vertices.join(self.in_degrees(), "id").join(self.out_degrees(), "id")

    def degree_histogram(self) -> DataFrame:
        return self.in_degrees().groupBy("in_deg").agg(F.count("*").alias("n"))

    def mirrors(self) -> DataFrame:
        """tile, vid, master_tile, acc_deg: what each tile knows of other tiles' vertices, and by how many edges."""
        e = self.tiled_edges().where("src_tile <> dst_tile")
        return e.groupBy(F.col("src_tile").alias("tile"), F.col("dst").alias("vid"), F.col("dst_tile").alias("master_tile")).agg(F.count("*").alias("acc_deg"))

    def mirror_positions(self) -> DataFrame:
        """Mirrors in the order in which one tile tells another of them: by id."""
        return numbered(self.mirrors(), ["vid"], "position", ["tile", "master_tile"])

    def tile_counts(self) -> DataFrame:
        """tile, vertices, edges, mirrors of every tile."""
        v = self.vertices.groupBy("tile").agg(F.count("*").alias("vertices"))
        known = self.tiled_edges().groupBy(F.col("src_tile").alias("tile"), "dst_tile", "dst").agg(F.count("*").alias("n"))
        e = known.groupBy("tile").agg(F.sum("n").alias("edges"), F.count_if(F.col("tile") != F.col("dst_tile")).alias("mirrors"))
        return v.join(e, "tile", "left").na.fill(0, ["edges", "mirrors"])

    def connectivity(self, folded: bool = False) -> DataFrame:
        """Distinct destinations between each pair of tiles; folded: both directions added up."""
        e = self.tiled_edges().where("src_tile <> dst_tile").groupBy("src_tile", "dst_tile").agg(F.countDistinct("dst").alias("mirrors"))
        if not folded:
            return e
        return e.groupBy(F.least("src_tile", "dst_tile").alias("tile_a"), F.greatest("src_tile", "dst_tile").alias("tile_b")).agg(F.sum("mirrors").alias("mirrors"))

    # orders

    def sorted_edges(self) -> DataFrame:
        return self.edges.orderBy("src", "dst", "weight")

    def padded_degrees(self, rotation: bool = False) -> DataFrame:
        """id, in_deg, padded_deg: to the next power of two, or with rotation only 0 to 1."""
        padded = F.greatest(F.col("in_deg"), F.lit(1)) if rotation else next_pow2(F.col("in_deg"))
        return self.in_degrees().select("id", "in_deg", padded.cast("long").alias("padded_deg"))

    def dummy_edges(self, rotation: bool = False) -> DataFrame:
        """The edges that pad in-degrees: src is the vertex itself, weight -1."""
        d = self.padded_degrees(rotation).where("padded_deg > in_deg")
        return d.select("id", F.explode(F.sequence(F.col("in_deg") + 1, F.col("padded_deg"))).alias("slot")).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(-1).cast("long").alias("weight"), "slot", F.lit(True).alias("is_dummy"))

    def mirror_dummies(self) -> DataFrame:
        """The edges that pad what a mirror gets in its tile to the next power of two, with rotation too: src is its first source, weight -1."""
        e = self.tiled_edges().where("src_tile <> dst_tile")
        mirrors = e.groupBy(F.col("src_tile").alias("tile"), "dst").agg(F.min("src").alias("src"), F.count("*").alias("acc_deg")).withColumn("padded", next_pow2(F.col("acc_deg")).cast("long"))
        some = mirrors.where("padded > acc_deg")
        return some.select("src", "dst", F.lit(-1).cast("long").alias("weight"), "tile", F.explode(F.sequence(F.col("acc_deg") + 1, F.col("padded"))).alias("slot"), F.lit(True).alias("is_dummy"))

    def padded_edges(self, rotation: bool = False) -> DataFrame:
        """Edges and the dummies of vertices and mirrors; where is_dummy doesn't send, any result is as without padding."""
        columns = ["src", "dst", "weight", "is_dummy"]
        return self.edges.withColumn("is_dummy", F.lit(False)).select(columns).union(self.dummy_edges(rotation).select(columns)).union(self.mirror_dummies().select(columns))

    def positions_by_degree(self, rotation: bool = False) -> DataFrame:
        """id, padded_deg, position: largest padded degree first, then by id."""
        d = self.padded_degrees(rotation).select("id", "padded_deg", (-F.col("padded_deg")).alias("descending"))
        return numbered(d, ["descending", "id"], "position").drop("descending")

    def first_of_runs(self) -> DataFrame:
        """The first edge of each destination in (dst, src, weight) order."""
        return self.edges.groupBy("dst").agg(F.min(F.struct("src", "weight")).alias("e")).select("dst", "e.src", "e.weight")

    def tile_ordinals(self) -> DataFrame:
        """id, tile, label: each vertex's place by id in its tile."""
        return numbered(self.vertices, ["id"], "label", ["tile"])

    def edge_slots(self) -> DataFrame:
        """Edges with their tiles and `slot`, an edge's place among those of the same pair of tiles, by source and destination."""
        return numbered(self.tiled_edges(), ["src", "dst", "weight"], "slot", ["src_tile", "dst_tile"])

    def on_slots(self, state: DataFrame) -> DataFrame:
        """state (id, columns) laid out on the edge slots: src_tile, dst_tile, slot, dst and the source's columns."""
        columns = [c for c in state.columns if c not in ("id", "tile")]
        return self.edge_slots().join(state.select(F.col("id").alias("src"), *columns), "src").select("src_tile", "dst_tile", "slot", "dst", *columns)

    def from_mirrors(self, merged: DataFrame, columns: list[str]) -> DataFrame:
        """(src_tile, dst, columns) brought to all vertices of the master tile, one row for each tile that sends there: is_dummy where that tile has no mirror."""
        tiles = merged.select("src_tile", F.col("dst").alias("id")).join(self.vertices, "id").select("src_tile", "tile").distinct()
        every = self.vertices.join(tiles, "tile")
        found = merged.select("src_tile", F.col("dst").alias("id"), *columns, F.lit(False).alias("is_dummy"))
        return every.join(found, ["src_tile", "id"], "left").select("src_tile", "id", "tile", *columns, F.coalesce("is_dummy", F.lit(True)).alias("is_dummy"))

    def cut_edges(self) -> DataFrame:
        """edges, cut: how many edges there are, and how many of them between tiles."""
        return self.tiled_edges().agg(F.count("*").alias("edges"), F.count_if(F.col("src_tile") != F.col("dst_tile")).alias("cut"))

    def run_bounds(self) -> DataFrame:
        """Edges in (dst, src) order with is_last: whether the next one has another destination."""
        n = self.edges.groupBy("dst").agg(F.count("*").alias("n_"))
        return numbered(self.edges, ["src", "weight"], "place_", ["dst"]).join(n, "dst").select("src", "dst", "weight", (F.col("place_") == F.col("n_") - 1).alias("is_last"))

    def merged_in_pairs(self, cut_every: int = 4) -> DataFrame:
        """dst, least, updates, rounds: a vertex's updates (its in-edges' weights) merged two by two, round after round, until one is left."""
        entries = numbered(self.edges, ["src", "weight"], "place", ["dst"]).select("dst", "place", F.col("weight").alias("least"), F.lit(1).cast("long").alias("updates"), F.lit(0).alias("rounds"))
        now, kept, r = entries, None, 0
        last = entries.agg(F.max("place")).first()[0] or 0
        while last >> r:
            r += 1
            pair = now.groupBy("dst", F.shiftright("place", 1).alias("place"))
            now = pair.agg(F.min("least").alias("least"), F.sum("updates").alias("updates"), (F.min_by("rounds", now["place"]) + (F.count("*") > 1).cast("int")).alias("rounds"))
            if r % cut_every == 0:
                now, before = cut(now), kept
                kept = now
                if before is not None:
                    drop(before)
        return now.select("dst", "least", "updates", "rounds")

    def messages(self) -> DataFrame:
        """What a superstep sends between tiles: src_tile, dst_tile, messages (an edge each), merged (one a mirror), helper_tile."""
        n = self.vertices.agg(F.max("tile") + 1).first()[0] or 1
        e = self.tiled_edges().where("src_tile <> dst_tile")
        return e.groupBy("src_tile", "dst_tile").agg(F.count("*").alias("messages"), F.countDistinct("dst").alias("merged")).withColumn("helper_tile", F.pmod(F.col("src_tile") + 1, F.lit(n)))

    def traffic(self, message_bytes: int = 16) -> DataFrame:
        """src_tile, dst_tile, phase, rounds, messages, bytes: what each pair of tiles exchanges in a superstep.

        premerge  in each round over a mirror's updates, padded to a power of two, half as many messages as there still are
        scatter   one merged message a mirror
        gather    one message back to each mirror's master from its helper
        """
        mirrors = self.mirrors().select(F.col("tile").alias("src_tile"), F.col("master_tile").alias("dst_tile"), next_pow2(F.col("acc_deg")).cast("long").alias("padded"))
        n = mirrors.groupBy("src_tile", "dst_tile").agg(F.count("*").alias("mirrors"), F.sum(F.col("padded") - 1).alias("merges"), F.max("padded").alias("most"))
        phase = lambda name, rounds, messages: F.struct(F.lit(name).alias("phase"), rounds.cast("int").alias("rounds"), messages.cast("long").alias("messages"))
        phases = F.explode(F.array(phase("premerge", F.length(F.bin("most")) - 1, F.col("merges")), phase("scatter", F.lit(1), F.col("mirrors")), phase("gather", F.lit(1), F.col("mirrors"))))
        return n.select("src_tile", "dst_tile", phases.alias("p")).select("src_tile", "dst_tile", "p.*", (F.col("p.messages") * message_bytes).alias("bytes"))


def graph(spark: SparkSession, edges: list[tuple], tiles: dict[int, int] | None = None) -> Graph:
    """A graph from Python values, for small cases: (src, dst) or (src, dst, weight)."""
    rows = spark.createDataFrame([(e + (1,))[:3] for e in edges], "src long, dst long, weight long")
    if tiles is None:
        return Graph.from_edges(rows)
    return Graph.from_partition(rows, spark.createDataFrame(list(tiles.items()), "vid long, tile int"))
