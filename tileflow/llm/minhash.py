"""MinHash near-duplicates with sequential Bayesian verification.

A text's set is its distinct shingles of SHINGLE words; words are [^\\x20\\x09-\\x0D]+ after A-Z is lower-cased; a text
with fewer words has its whole sequence as its one shingle, a null or wordless text has none and links with nothing.

1. Texts with equal sets are one class, known by a number of its own from here on.
2. BANDS x ROWS min-hashes give each class BANDS keys; classes that share a key are in one bucket. A pair at the
   threshold of 0.8 misses every bucket with probability (1 - 0.8 ** ROWS) ** BANDS, about 5e-8.
3. In each bucket every class is a candidate with the bucket's smallest (a star, not all pairs).
4. A candidate's other MATCHES min-hashes are compared STEP by STEP; after each step it is dropped if the posterior
   probability of a similarity of the threshold or more, from a uniform prior, is below MISS.
5. Survivors are verified on their full sets; links give components.
6. While a bucket of three or more still holds two components or more, STARS classes of its largest one, drawn by hash,
   are compared in the same way with those outside it, in up to TURNS turns: large groups of near copies end here.
7. In buckets that still hold two components or more, the classes outside the bucket's largest component are compared
   with all its classes, in blocks of BLOCK: first by step 4 on min-hashes alone, which leaves the classes with any
   survivor; then, of these, on full sets, pair by pair until the two are joined. A block gives a forest of its links,
   never pairs. So no link depends on which class leads a bucket.

Rows that share a doc_id are one node of the components, and each gives a row: their classes are joined like linked ones,
and every one's links count. Null ids stand alone. Shingles are compared as 64-bit hashes, sets as 128 bits.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.llm.common import Memo, as_bytes, discard, map_batches, materialise, ready
from tileflow.llm.components import connected_components, same_ids, with_components

SHINGLE, PERCENT = 4, 80
BANDS, ROWS, MATCHES, STEP, MISS = 32, 4, 128, 32, 1e-6
STARS, TURNS, BLOCK = 4, 1, 512
_CHUNK = 4096

_random = np.random.default_rng(20240229)
_SEEDS = _random.integers(0, 1 << 32, (BANDS * ROWS + MATCHES, 1), dtype=np.uint32)
_ODD = _random.integers(0, 1 << 32, (BANDS * ROWS + MATCHES, 1), dtype=np.uint32) | np.uint32(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Shingles:
    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.word = Memo(lambda w: xxhash.xxh64_intdigest(w))

    def hashes(self, raw: bytes | None) -> np.ndarray:
        """The sorted distinct hashes of a text's shingles. raw: its UTF-8."""
        words = raw.lower().split() if raw else []
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        if n < self.size:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], np.uint64)
        w = np.fromiter(map(self.word.__getitem__, words), np.uint64, n)
        h = w[: n - self.size + 1].copy()
        for k in range(1, self.size):
            h = (h * _A) ^ (h >> np.uint64(29))
            h += w[k : n - self.size + 1 + k]
        h = (h ^ (h >> np.uint64(32))) * _B
        return np.unique(h ^ (h >> np.uint64(29)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The min-hashes of a set that isn't empty."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_SEEDS), 0xFFFFFFFF, np.uint32)
    for s in range(0, len(x), _CHUNK):
        np.minimum(least, ((x[s : s + _CHUNK] ^ _SEEDS) * _ODD).min(axis=1), out=least)
    return least


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _B
    for k in range(ROWS):
        key = (key ^ (key >> np.uint64(31))) * _A + rows[:, k]
    return ((key ^ (key >> np.uint64(32))) * _B).view(np.int64)


def matches_part(sig: np.ndarray) -> np.ndarray:
    return (sig[BANDS * ROWS :] >> np.uint32(16)).astype(np.uint16)


@lru_cache(8)
def least_matches(percent: int = PERCENT, miss: float = MISS) -> tuple[int, ...]:
    """After each step, how many matches a candidate needs: with fewer, P(similarity >= threshold) < miss.

    With a uniform prior, m matches of n leave Beta(m + 1, n - m + 1), whose tail is a binomial sum.
    """
    t, out = percent / 100, []
    for n in range(STEP, MATCHES + 1, STEP):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survives(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """For rows a and b of min-hashes, which pairs the steps don't drop."""
    alive, m = np.arange(len(a)), np.zeros(len(a), int)
    for k, need in enumerate(least_matches(percent)):
        s = slice(k * STEP, (k + 1) * STEP)
        m[alive] += (a[alive, s] == b[alive, s]).sum(axis=1)
        alive = alive[m[alive] >= need]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 |a and b| >= percent |a or b| for two sorted distinct arrays."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("t", F.xxhash64("text"))


def _read(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, a hash of the text, set size, 128 bits of the set, band keys and the other min-hashes; the last four null without a set."""

    def make():
        shingles = Shingles(size)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            n, d1, d2, keys, rest = [], [], [], [], []
            for raw in as_bytes(b.column(1)):
                h = shingles.hashes(raw)
                n.append(len(h))
                if len(h):
                    sig, packed = signature(h), h.tobytes()
                    digest = xxhash.xxh128_digest(packed)
                    d1.append(int.from_bytes(digest[:8], "little", signed=True))
                    d2.append(int.from_bytes(digest[8:], "little", signed=True))
                    keys.append(band_keys(sig).tobytes())
                    rest.append(matches_part(sig).tobytes())
                else:
                    for x in (d1, d2, keys, rest):
                        x.append(None)
            return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.binary()), pa.array(rest, pa.binary())], ["doc_id", "t", "n", "d1", "d2", "keys", "rest"])

        return one

    return map_batches(_source(docs), make, "doc_id long, t long, n long, d1 long, d2 long, keys binary, rest binary")


def _buckets(classes: DataFrame) -> DataFrame:
    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["key", "id"])

        return one

    return map_batches(classes.select("id", "keys"), make, "key long, id long")


def _prune(pairs: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the steps don't drop."""
    both = pairs.join(rest.select(F.col("id").alias("a"), F.col("rest").alias("x")), "a").join(rest.select(F.col("id").alias("b"), F.col("rest").alias("y")), "b").select("a", "b", "x", "y")

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, MATCHES) for c in ("x", "y"))
            return batch.select(["a", "b"]).filter(pa.array(survives(x, y, percent)))

        return one

    return map_batches(both, make, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").select("a", "b", "x", "y")

    def make():
        shingles = Shingles(size)
        last: list = [None, None]

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(as_bytes(batch.column("x")), as_bytes(batch.column("y")), strict=True):
                if last[0] != x:
                    last[:] = [x, shingles.hashes(x)]
                keep.append(similar(last[1], shingles.hashes(y), percent))
            return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return one

    return map_batches(both, make, "a long, b long")


def compare_block(ids: list[int], components: list[int], rest: np.ndarray, texts: list[bytes], first: np.ndarray, percent: int, shingles: Shingles) -> list[tuple[int, int]]:
    """Links between different components, of a block's left side (first) with its right, as a forest."""
    root = {c: c for c in components}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    sets: dict[int, np.ndarray] = {}

    def hashes(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingles.hashes(texts[k])
        return sets[k]

    found = []
    part = np.array(components)
    for k in np.flatnonzero(first):
        others = np.flatnonzero((part != part[k]) & ~first)
        others = others[survives(np.broadcast_to(rest[k], (len(others), MATCHES)), rest[others], percent)]
        for o in others:
            if find(components[k]) != find(components[o]) and similar(hashes(k), hashes(o), percent):
                found.append((ids[k], ids[o]))
                root[find(components[k])] = find(components[o])
    return found


def _unsettled(spark: SparkSession, members: DataFrame, component: DataFrame) -> DataFrame:
    """(key, id, component, core, n, outside) of the buckets with three classes or more and two components or more.

    core is the bucket's largest component; n classes are in the bucket, outside of them not in the core. The buckets are
    written first: a join with a table alone can be split where a bucket is large.
    """
    now = materialise(spark, members.join(component, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("component")), "minhash-now")
    sizes = now.groupBy("key", "component").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("core"), F.sum("n").alias("n")).select("key", F.col("core.component").alias("core"), "n", (F.col("n") - F.col("core.n")).alias("outside"))
    some = materialise(spark, buckets.where("outside > 0 AND n > 2"), "minhash-unsettled")
    out = materialise(spark, now.join(some, "key"), "minhash-members")
    discard(spark, now, some)
    return out


def _star(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of STARS classes of each bucket's core, drawn by hash, with the classes outside."""
    drawn = [F.min(F.struct(F.xxhash64("id", F.lit(100 + turn * STARS + k)).alias("h"), "id")).alias(f"l{k}") for k in range(STARS)]
    leaders = members.where("component = core").groupBy("key").agg(*drawn).select("key", F.array_distinct(F.array(*[F.col(f"l{k}.id") for k in range(STARS)])).alias("leaders"))
    both = members.where("component <> core").select("key", "id").join(leaders, "key").select("id", F.explode("leaders").alias("l"))
    return both.select(F.least("l", "id").alias("a"), F.greatest("l", "id").alias("b")).distinct()


def _rest_of_links(spark: SparkSession, members: DataFrame, rest: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The rest of the links of _unsettled() buckets."""
    one = members.withColumns({"lefts": F.ceil(F.col("outside") / BLOCK).cast("int"), "rights": F.ceil(F.col("n") / BLOCK).cast("int")})
    place = F.xxhash64("id", F.lit(3))
    left = one.where("component <> core").select("key", "id", "component", F.lit(True).alias("left"), F.pmod(place, "lefts").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"))
    right = one.select("key", "id", "component", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), F.pmod(place, "rights").cast("int").alias("j"))
    columns = ["key", "i", "j", "id", "component", "left"]

    def table(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        group = group.sort_by("id")
        matches = np.frombuffer(b"".join(group.column("rest").to_pylist()), np.uint16).reshape(-1, MATCHES)
        return group, matches, group.column("left").to_numpy(), group.column("component").to_numpy()

    def narrow(group: pa.Table) -> pa.Table:
        group, matches, first, part = table(group)
        keep = np.zeros(len(group), bool)
        for k in np.flatnonzero(first):
            others = np.flatnonzero((part != part[k]) & ~first)
            others = others[survives(np.broadcast_to(matches[k], (len(others), MATCHES)), matches[others], percent)]
            keep[others] = True
            keep[k] = len(others) > 0
        return group.select(columns).filter(pa.array(keep))

    def compare(group: pa.Table) -> pa.Table:
        group, matches, first, part = table(group)
        found = compare_block(group.column("id").to_pylist(), part.tolist(), matches, group.column("text").cast(pa.binary()).to_pylist(), first, percent, Shingles(size))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    grid = left.union(right).select(columns).join(rest.select("id", "rest"), "id")
    few = materialise(spark, grid.groupBy("key", "i", "j").applyInArrow(narrow, "key long, i int, j int, id long, component long, left boolean"), "minhash-survivors")
    full = few.join(rest.select("id", "rest"), "id").join(texts.select("id", "text"), "id")
    out = materialise(spark, full.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"), "minhash-links")
    discard(spark, few)
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    ready(spark)
    read = materialise(spark, _read(docs, size), "minhash-sets")
    sets = read.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.first("keys").alias("keys"), F.first("rest").alias("rest"))
    classes = materialise(spark, sets.withColumn("id", F.monotonically_increasing_id()), "minhash-classes")
    has_set = F.coalesce(F.col("n") > 0, F.lit(False)) & F.col("doc_id").isNotNull()
    known = read.where(has_set).select(F.col("doc_id").alias("id"), "t", "n", "d1", "d2").join(classes.select("d1", "d2", F.col("id").alias("c")), ["d1", "d2"]).select("id", "t", "n", "c")
    rows = materialise(spark, known.union(read.where(~has_set).select("doc_id", "t", "n", F.lit(None).cast("long"))), "minhash-rows")
    leaders = materialise(spark, _buckets(classes).groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last").select("key", "leader"), "minhash-leaders")
    shared = materialise(spark, _buckets(classes).join(leaders, "key").select("key", "id", "leader"), "minhash-buckets")
    pairs = shared.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    rest = classes.select("id", "rest")
    pruned = materialise(spark, _prune(pairs, rest, percent), "minhash-pairs")
    # one text for each class that shares a bucket, that of its smallest doc_id
    stands = rows.where("c IS NOT NULL").groupBy(F.col("c").alias("id")).agg(F.min(F.struct(F.col("id"), "t")).alias("of")).select("id", F.col("of.id").alias("doc_id"), "of.t")
    wanted = shared.select("id").distinct().join(stands, "id")
    texts = materialise(spark, _source(docs).join(wanted, ["doc_id", "t"]).select("id", "text").dropDuplicates(["id"]), "minhash-texts")
    links = [same_ids(rows), _links(materialise(spark, _verify(pruned, texts, size, percent), "minhash-links"))]
    joined = lambda: connected_components(spark, _union(links))
    component = joined()
    members = _unsettled(spark, shared.select("key", "id"), component)
    for turn in range(TURNS):
        found = materialise(spark, _verify(_prune(_star(members, turn), rest, percent), texts, size, percent), "minhash-links")
        if found.isEmpty():
            break
        links.append(_links(found))
        component, before = joined(), members
        members = _unsettled(spark, members.select("key", "id"), component)
        discard(spark, before)
    found = _rest_of_links(spark, members, rest, texts, size, percent)
    if not found.isEmpty():
        links.append(_links(found))
        component = joined()
    discard(spark, shared, leaders, pruned, texts, members, classes, read)
    out = with_components(spark, rows, component).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out, *more = parts
    for p in more:
        out = out.union(p)
    return out


def keep_one(spark: SparkSession, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that are kept: of each component the smallest id's, of equal rows (doc_id, text) one; rows without an id stay."""
    kept = near_duplicates(spark, docs, size, percent).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    known = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return known.select(*docs.columns).union(docs.where("doc_id IS NULL"))
