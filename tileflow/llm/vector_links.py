"""Embedding near-duplicates: an exact range join in a metric space, cut into cells by pivots.

Unit vectors with cosine >= t are at most eps = sqrt(2 - 2t) apart. Each label (and length) has its own pivots, taken
farthest-first from a sample: about sqrt(n) / PIVOTS_ROOT of its n vectors, LABEL_PIVOTS at most, and all labels'
together PIVOT_BYTES at most, which is what is broadcast. A vector's home is the cell of its nearest pivot p. By the
triangle inequality nothing within eps of a vector x lives in q's cell if (d(x,q)^2 - d(x,p)^2) / (2 d(p,q)) > eps; into the
other cells x is copied, of two cells only into the one that a fixed rule names, so each pair of vectors meets once: in the home
cell of both, or in that of one. Cells are joined independently; the links found are counted for both sides.

Within a cell vectors are sorted by their distance to its pivot, and a vector is only compared with those whose distance
differs by eps at most (the triangle inequality again). A cell is dealt out as a grid of blocks (HOME_BLOCK x
MEMBER_BLOCK) that are compared in double precision; a block gives counts and a spanning forest of its links, never
pairs. Vectors are kept as they are (float or double) until then.

Vectors with other labels, or other lengths, never meet. Equal vectors of a label (128-bit hashes) are one class with a
count and are compared once.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows without a label, link with nothing:
no links, a component of their own, kept. Rows that share a vec_id are told apart in counts but are one node of the
components. Rows without a vec_id link with nothing. Cosines within ROUNDING of the threshold are computed again with
exact sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.llm.common import discard, materialise, ready
from tileflow.llm.components import connected_components, same_ids, with_components

PIVOTS_ROOT, LABEL_PIVOTS, PIVOT_BYTES = 4, 4096, 64 << 20
#: Sampled vectors for each pivot that is to be taken from them.
SAMPLE = 8
HOME_BLOCK, MEMBER_BLOCK, ROWS = 2048, 8192, 256
ROUNDING = 1e-12


def _usable(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.empty((0, 0))


def farthest_first(vectors: np.ndarray, k: int) -> np.ndarray:
    """The places of k vectors, or as many as differ: the first, then always the one farthest from those taken."""
    taken, gap = [0], 2 - 2 * np.clip(vectors @ vectors[0], -1, 1)
    while len(taken) < k and gap.max() > 1e-9:
        taken.append(int(gap.argmax()))
        np.minimum(gap, 2 - 2 * np.clip(vectors @ vectors[taken[-1]], -1, 1), out=gap)
    return np.array(taken)


def cells_for(vectors: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each unit vector's home cell, for which cells it is a member (its home among them), and its distances to the pivots."""
    gap = np.maximum(2 - 2 * np.clip(vectors @ pivots.T, -1, 1), 0)  # squared distances
    home = gap.argmin(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * np.clip(pivots @ pivots.T, -1, 1), 0))[home]
    over = gap - gap[np.arange(len(home)), home][:, None]
    member = over <= 2 * apart * eps + 1e-9
    # of cells a < b, those of b's vectors come to a if a + b is odd, else a's come to b
    a, b = home[:, None], np.arange(len(pivots))[None, :]
    member &= np.where((a + b) % 2 == 1, b < a, b > a)
    member[np.arange(len(home)), home] = True
    return home, member, np.sqrt(gap)


class Forest:
    """Groups of the numbers below n, each with its smallest as the root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            low = np.minimum(x, y)
            if (x == y).all():
                return
            np.minimum.at(self.root, x, low)
            np.minimum.at(self.root, y, low)
            while not np.array_equal(jumped := self.root[self.root], self.root):
                self.root = jumped


def link_block(home: np.ndarray, members: np.ndarray, at: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray], inside: np.ndarray, weight: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, Forest]:
    """The weights of the partners of each row of home and of each member from another cell; the forest over home rows, then members.

    at: the rows' distances to the cell's pivot, in order; own: their classes; inside: which members are of the cell itself.
    """
    a, b = _unit(home), _unit(members)
    n, eps = len(home), math.sqrt(2 - 2 * threshold) + 1e-6
    counts, others, forest = np.zeros(n, np.int64), np.zeros(len(members), np.int64), Forest(n + len(members))
    for s in range(0, n, ROWS):
        rows = slice(s, min(s + ROWS, n))
        lo, hi = np.searchsorted(at[1], at[0][rows][0] - eps, "left"), np.searchsorted(at[1], at[0][rows][-1] + eps, "right")
        if lo == hi:
            continue
        cos = a[rows] @ b[lo:hi].T
        close = cos >= threshold
        for i, j in zip(*np.nonzero(np.abs(cos - threshold) <= ROUNDING), strict=True):
            close[i, j] = exact_cosine(home[s + i], members[lo + j]) >= threshold
        i, j = np.nonzero(close)
        other = own[0][s + i] != own[1][lo + j]
        i, j = s + i[other], lo + j[other]
        np.add.at(counts, i, weight[1][j])
        far = ~inside[j]
        np.add.at(others, j[far], weight[0][i[far]])
        forest.join(i, n + j)
    return counts, others, forest


def _pivots(spark: SparkSession, classes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Pivots by label and length: one row a label comes to the driver for their numbers, and the pivots themselves."""
    sizes = classes.groupBy("label", "d").agg(F.count("*").alias("n"))
    wanted = sizes.withColumn("k", F.least(F.lit(LABEL_PIVOTS), F.ceil(F.sqrt("n") / PIVOTS_ROOT)).cast("int"))
    total = wanted.agg(F.sum(F.col("k").cast("long") * F.col("d") * 8)).first()[0] or 0
    if total > PIVOT_BYTES:
        wanted = wanted.withColumn("k", F.floor(F.col("k") * (PIVOT_BYTES / total)).cast("int"))
    wanted = wanted.where("k > 1")  # with one pivot or none a label is one cell
    rate = F.least(F.lit(1.0), F.col("k") * SAMPLE / F.col("n"))
    sample = classes.join(F.broadcast(wanted), ["label", "d"]).where(F.pmod("h1", F.lit(1 << 30)) / float(1 << 30) < rate)

    def take(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("h1", "ascending"), ("h2", "ascending")])
        at = farthest_first(_unit(_matrix(group.column("v").combine_chunks())), group.column("k")[0].as_py())
        return group.take(pa.array(at)).select(["label", "d", "v"]).append_column("k", pa.array(np.arange(len(at), dtype=np.int32)))

    kind = sample.schema["v"].dataType.simpleString()
    found: dict[tuple[str, int], list] = {}
    for r in sample.select("label", "d", "v", "h1", "h2", "k").groupBy("label", "d").applyInArrow(take, f"label string, d int, v {kind}, k int").orderBy("label", "d", "k").collect():
        found.setdefault((r.label, r.d), []).append(r.v)
    return {key: _unit(np.array(v, float)) for key, v in found.items()}


def place_vectors(spark: SparkSession, classes: DataFrame, threshold: float) -> DataFrame:
    """classes (label, d, v, c, mult, h1, h2) with cell, home (whether it is the vector's own) and at, the distance to its pivot: a row a copy."""
    eps = math.sqrt(2 - 2 * threshold)
    shared = spark.sparkContext.broadcast(_pivots(spark, classes))
    kept = ["label", "d", "v", "c", "mult"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for b in batches:
            keys = list(zip(b.column("label").to_pylist(), b.column("d").to_pylist(), strict=True))
            for key in sorted(set(keys)):
                part = b.filter(pa.array([k == key for k in keys]))
                if key in pivots:
                    home, member, gap = cells_for(_unit(_matrix(part.column("v"))), pivots[key], eps)
                else:
                    home, member, gap = np.zeros(len(part), int), np.ones((len(part), 1), bool), np.zeros((len(part), 1))
                row, cell = np.nonzero(member)
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(row)) for c in kept] + [pa.array(cell.astype(np.int32)), pa.array(home[row] == cell), pa.array(gap[row, cell])], [*kept, "cell", "home", "at"])

    kind = classes.schema["v"].dataType.simpleString()
    return classes.select(kept).mapInArrow(place, f"label string, d int, v {kind}, c long, mult long, cell int, home boolean, at double")


def link_vectors(spark: SparkSession, rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of rows (vec_id, embedding, label)."""
    ready(spark)
    of = rows.schema["embedding"].dataType.elementType.simpleString()
    of = of if of in ("float", "double") else "double"
    read = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(f"array<{of}>").alias("v"), F.col("label").cast("string").alias("label"))
    ok = _usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    read = materialise(spark, read.withColumn("ok", ok).withColumns({"h1": F.when(F.col("ok"), F.xxhash64("label", "v")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(7), "v", "label"))}), "vectors")
    equal = read.where("ok").groupBy("h1", "h2").agg(F.count("*").alias("mult"), F.first("v").alias("v"), F.first("label").alias("label"))
    classes = materialise(spark, equal.select("label", F.size("v").alias("d"), "v", F.monotonically_increasing_id().alias("c"), "mult", "h1", "h2"), "vector-classes")
    placed = materialise(spark, place_vectors(spark, classes, threshold), "vector-cells")
    at = ["label", "d", "cell"]
    sizes = materialise(spark, placed.groupBy(*at).agg(F.ceil(F.count_if("home") / HOME_BLOCK).cast("int").alias("homes"), F.ceil(F.count("*") / MEMBER_BLOCK).cast("int").alias("members")).where("homes > 0"), "vector-sizes")
    both = placed.join(sizes, at)
    salt = F.xxhash64("c", F.lit(9))
    columns = [*at, "v", "c", "mult", "home", "at"]
    as_home = both.where("home").select(*columns, F.lit(True).alias("left"), F.pmod(salt, "homes").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("members") - 1)).alias("j"))
    as_member = both.select(*columns, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("i"), F.pmod(salt, "members").cast("int").alias("j"))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("at", "ascending"), ("c", "ascending")])
        left = group.column("left").to_numpy()
        h, m = group.filter(pa.array(left)), group.filter(pa.array(~left))
        if not len(h) or not len(m):
            return pa.table({"c": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        c, gap, weight = ([t.column(x).to_numpy() for t in (h, m)] for x in ("c", "at", "mult"))
        vectors = [_matrix(t.column("v").combine_chunks()).astype(float) for t in (h, m)]
        links, others, forest = link_block(*vectors, tuple(gap), tuple(c), m.column("home").to_numpy(), tuple(weight), threshold)
        every, least = np.concatenate(c), np.full(len(forest.root), np.iinfo(np.int64).max)
        np.minimum.at(least, forest.root, every)
        root, found = least[forest.root], np.concatenate([links, others])
        keep = (root != every) | (found > 0)
        return pa.table({"c": every[keep], "links": found[keep], "root": root[keep]})

    blocks = as_home.union(as_member).groupBy(*at, "i", "j").applyInArrow(compare, "c long, links long, root long")
    blocks = materialise(spark, blocks, "vector-links")
    discard(spark, placed, sizes)
    counts = blocks.where("links > 0").groupBy("c").agg(F.sum("links").alias("links"))
    known = read.where("ok").join(classes.select("h1", "h2", "c", "mult"), ["h1", "h2"]).join(counts, "c", "left").select("id", "c", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"))
    every = materialise(spark, known.union(read.where("NOT ok").select("id", F.lit(None).cast("long"), F.lit(0).cast("long"))), "vector-rows")
    component = connected_components(spark, blocks.where("root <> c").select(F.col("c").alias("u"), F.col("root").alias("v")).union(same_ids(every)))
    discard(spark, read, classes, blocks)
    out = with_components(spark, every, component).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
