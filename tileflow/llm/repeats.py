"""Substring deduplication with a log-structured fingerprint index.

A window is SPAN consecutive words ([^\\x20\\x09-\\x0D]+, unchanged) of one text. Every word covered by a window whose
words also start anywhere else, in the same text too, is removed; windows are judged on the input.

Fingerprints. A window's anchor is the leftmost of its GRAM-word runs with the least hash, so equal windows have equal
anchors at equal places. Neighbouring windows with the same anchor make a block; its entry (anchor hash, block hash)
stands for all of them, about 1 entry for 14 words. Windows can only be equal under equal anchors.

Index. Entries are kept as immutable runs (anchor, block, n), bucketed by anchor and sorted by both, in one folder with
a manifest. A batch of documents becomes a new run; it is merge-joined by anchor with every historical run as it lies
there (no exchange, no sort), which gives the anchors it shares with history or within itself. When there are more than
max_runs runs, the newest are merged, and with them each older one that isn't over twice as large. An index that is
opened by path also keeps where each block stands, and outlives the session: commit() writes the next manifest, and what
was not committed isn't there for the next open(). Without a path it is of one call. The number of buckets is fixed when
an index is made (spark.sql.shuffle.partitions, or as told).

History. With an index, remove_repeats judges the given documents together with all those the index holds, and its rows
for them are those of one call on all. Documents of earlier calls aren't judged again, so what they lost stays what
they lost; their texts are read (from the table given as history) for those blocks only that share an anchor with a new
document and aren't equal as a whole.

Verification. Of the shared anchors, a block that occurs twice or more (128 bits: anchor and block) is repeated as a
whole. A block that occurs once, under an anchor with other blocks, is compared window by window: the texts are
fetched, and the windows' own words (128-bit hashes of the bytes) are matched against those of the anchor's other
blocks, one document standing for each repeated block. So the result is that of comparing all windows, whichever way
the documents fall into batches.

Null texts have no words; texts under SPAN words lose none. Repeated rows each give a row, and repeat each other. Rows
are told apart by id and a 64-bit hash of the text, so equal ids and null ids do no harm.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.llm.common import Memo, as_bytes, discard, map_batches, materialise, ready, release, remove
from tileflow.plans.lineage import shared_path

SPAN, GRAM = 35, 8
BATCHES, MAX_RUNS = 3, 2
#: Shares into which the blocks of an anchor are dealt, so that a frequent one isn't one task's.
SALTS = 8
#: Windows handled at once: positions fit into the low bits of a key.
CHUNK, _POSITION = 1 << 18, np.uint64((1 << 20) - 1)

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_R = 0xA0761D6478BD642F
_INVERSE = pow(_R, -1, 1 << 64)
NOTHING = hashlib.sha256(b"").hexdigest()


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


class Anchors:
    """Cuts texts into words and words into blocks."""

    def __init__(self) -> None:
        self.word = Memo(lambda w: xxhash.xxh64_intdigest(w))
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = _powers(_R, n), _powers(_INVERSE, n)

    def blocks(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, block hash, first window, last window) of each block of a text's windows."""
        n = len(words) - SPAN + 1
        if n <= 0:
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.int32),) * 2
        w = np.fromiter(map(self.word.__getitem__, words), np.uint64, len(words))
        parts = [self._chunk(w[s : s + CHUNK + SPAN - 1], s) for s in range(0, n, CHUNK)]
        return tuple(map(np.concatenate, zip(*parts, strict=True)))

    def _chunk(self, w: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
        n = len(w) - SPAN + 1
        self._grow(len(w) + 1)
        m = len(w) - GRAM + 1
        gram = w[:m].copy()
        for k in range(1, GRAM):
            gram = gram * _A + w[k : k + m]
        gram = _mix(gram)
        low = (gram & ~_POSITION) | np.arange(m, dtype=np.uint64)
        size, width = 1, SPAN - GRAM + 1
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[:n], low[width - size : width - size + n])
        place = (low & _POSITION).astype(np.int64)
        turn = np.flatnonzero(place[1:] != place[:-1])
        lo, hi = np.concatenate(([0], turn + 1)), np.concatenate((turn, [n - 1]))
        total = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * self.up[: len(w)], dtype=np.uint64, out=total[1:])
        block = _mix((total[hi + SPAN] - total[lo]) * self.down[lo] + (hi - lo).astype(np.uint64) * _B)
        return gram[place[lo]].view(np.int64), block.view(np.int64), (lo + at).astype(np.int32), (hi + at).astype(np.int32)


def _text_hash() -> Column:
    return F.xxhash64(F.col("text"), F.col("doc_id").isNull())


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).cast("long").alias("k1"), _text_hash().alias("k2"))


def _read(source: DataFrame) -> DataFrame:
    """A row a document: its key, number of words, hash of all its words, and its blocks."""

    def make():
        cut = Anchors()

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            n, kept, columns = [], [], [[], [], [], []]
            for raw in as_bytes(b.column("text")):
                words = raw.split() if raw else []
                n.append(len(words))
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
                for column, values in zip(columns, cut.blocks(words), strict=True):
                    column.append(values)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            arrays = [b.column(c) for c in ("doc_id", "k1", "k2")] + [pa.array(n, pa.int64()), pa.array(kept, pa.string())] + [pa.array(c, pa.list_(t)) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "k1", "k2", "n_words", "whole", "anchor", "block", "lo", "hi"])

        return one

    return map_batches(source, make, "doc_id long, k1 long, k2 long, n_words long, whole string, anchor array<long>, block array<long>, lo array<int>, hi array<int>")


#: What an index holds: blocks with the number of their places, and the places, the latter only where it is to last.
RUNS = {"entries": "anchor BIGINT, block BIGINT, n BIGINT", "places": "anchor BIGINT, block BIGINT, k1 BIGINT, k2 BIGINT, lo INT, hi INT"}


class FingerprintIndex:
    """Sorted immutable runs in a folder: use open(); add(), then commit() once the result is written."""

    def __init__(self, spark: SparkSession, path: str | None = None, max_runs: int = MAX_RUNS, buckets: int | None = None):
        self.spark, self.lasting, self.max_runs = spark, path is not None, max_runs
        self.path = path.rstrip("/") if path else shared_path(spark, "repeats-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version = 0
        self.runs: dict[str, list[tuple[str, int]]] = {kind: [] for kind in RUNS}
        self.obsolete: list[str] = []
        # buckets are one sorted file each: let a scan say so
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    @classmethod
    def open(cls, spark: SparkSession, path: str, max_runs: int = MAX_RUNS, buckets: int | None = None) -> FingerprintIndex:
        """The index at path as last committed; a new one where there is none."""
        index = cls(spark, path, max_runs, buckets)
        fs, folder = index._fs(f"{index.path}/manifest")
        versions = [int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()] if fs.exists(folder) else []
        if versions:
            index.version = max(versions)
            stream = fs.open(index._fs(f"{index.path}/manifest/{index.version:08}")[1])
            found = json.loads(bytes(stream.readAllBytes()))
            stream.close()
            index.buckets = found["buckets"]
            index.runs = {kind: [tuple(r) for r in found[kind]] for kind in RUNS}
            for kind in RUNS:
                for name, _ in index.runs[kind]:
                    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({RUNS[kind]}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor, block) INTO {index.buckets} BUCKETS LOCATION '{index.path}/{name}'")
        return index

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _write(self, kind: str, rows: DataFrame) -> None:
        name = f"tileflow_{kind}_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "anchor").sortBy("anchor", "block").option("path", f"{self.path}/{name}").option("compression", "zstd").saveAsTable(name)
        self.runs[kind].append((name, self.spark.table(name).count()))

    def _tables(self, kind: str) -> list[DataFrame]:
        return [self.spark.table(name) for name, _ in self.runs[kind]]

    def _union(self, kind: str) -> DataFrame | None:
        rows, *others = self._tables(kind) or [None]
        for o in others:
            rows = rows.union(o)
        return rows

    def add(self, blocks: DataFrame) -> DataFrame:
        """Add a batch's (anchor, block); returns the anchors that it shares with history or within itself."""
        history = self._tables("entries")
        entries = blocks.groupBy("anchor", "block").agg(F.count("*").alias("n"))
        self._write("entries", entries.repartition(self.buckets, "anchor"))
        run = self._tables("entries")[-1]
        shared = run.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
        for old in history:
            shared = shared.union(self.merge_join(run, old))
        shared = materialise(self.spark, shared.distinct(), "repeats-shared")
        self.compact("entries")
        return shared

    @staticmethod
    def merge_join(run: DataFrame, old: DataFrame) -> DataFrame:
        """The anchors of run's rows that old has too: both are read in their order."""
        return run.select("anchor").join(old.select("anchor").hint("merge"), "anchor", "left_semi")

    def add_places(self, blocks: DataFrame) -> None:
        """Keep where the blocks stand; one block may have any number of places, so those of a frequent one are many rows of one bucket (written in a stream, never held)."""
        self._write("places", blocks.select("anchor", "block", "k1", "k2", "lo", "hi").repartition(self.buckets, "anchor"))
        self.compact("places")

    def compact(self, kind: str, everything: bool = False) -> None:
        """Merge the newest runs, and older ones as long as they aren't over twice as large as what is merged."""
        runs = self.runs[kind]
        if len(runs) < 2 or not (everything or len(runs) > self.max_runs):
            return
        k = len(runs) - 2
        while k and (everything or runs[k - 1][1] <= 2 * sum(n for _, n in runs[k:])):
            k -= 1
        old = runs[k:]
        rows, *others = [self.spark.table(name) for name, _ in old]
        for o in others:
            rows = rows.union(o)
        self.runs[kind] = runs[:k]
        self._write(kind, rows.groupBy("anchor", "block").agg(F.sum("n").alias("n")) if kind == "entries" else rows)
        self._drop([name for name, _ in old])

    def _drop(self, names: list[str]) -> None:
        """Of a lasting index, the files go only once a manifest without them is committed."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if self.lasting:
            self.obsolete += names
        else:
            remove(self.spark, *[f"{self.path}/{name}" for name in names])

    def entries(self, shared: DataFrame) -> DataFrame:
        """(anchor, block, full, emit) under the shared anchors: whether a block occurs again as a whole, and whether its windows have to be compared."""
        found = None
        for run in self._tables("entries"):
            some = run.join(shared, "anchor", "left_semi")
            found = some if found is None else found.union(some)
        found = found.groupBy("anchor", "block").agg(F.sum("n").alias("n"))
        found = materialise(self.spark, found, "repeats-found")
        # of a block that is there once, the anchor's least count is 1: it is compared if there are other blocks
        compared = found.groupBy("anchor").agg(F.count("*").alias("blocks"), F.min("n").alias("least")).where("blocks > 1 AND least = 1")
        compared = compared.select("anchor", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("compared"))
        both = found.withColumn("salt", F.pmod(F.hash("block"), F.lit(SALTS))).join(compared, ["anchor", "salt"], "left")
        return both.where("n > 1 OR compared").select("anchor", "block", (F.col("n") > 1).alias("full"), F.coalesce("compared", F.lit(False)).alias("emit"))

    def commit(self) -> None:
        """Write the next manifest; another writer that was faster makes this fail, and nothing of this one is in the index then."""
        text = json.dumps({"buckets": self.buckets, **self.runs}).encode()
        fs, made = self._fs(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(made, False)
        out.write(bytearray(text))
        out.close()
        _, target = self._fs(f"{self.path}/manifest/{self.version + 1:08}")
        if fs.exists(target) or not fs.rename(made, target):
            fs.delete(made, False)
            raise RuntimeError(f"{target.toString()} is there already: open the index again")
        self.version += 1
        remove(self.spark, *[f"{self.path}/{name}" for name in self.obsolete])
        self.obsolete = []

    def close(self) -> None:
        """Forget the tables; an index without a path is deleted."""
        for name, _ in (r for kind in RUNS for r in self.runs[kind]):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if not self.lasting:
            remove(self.spark, self.path)


def _windows(found: DataFrame) -> DataFrame:
    """(k1, k2, start, single, h1, h2) of every window of the blocks in jobs."""

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            k1, k2, start, single, digests = [], [], [], [], []
            for a, c, raw, jobs in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), as_bytes(b.column("text")), b.column("jobs").to_pylist(), strict=True):
                words = raw.split() if jobs else []
                for job in jobs or ():
                    for s in range(job["lo"], job["hi"] + 1):
                        digests.append(xxhash.xxh128_digest(b" ".join(words[s : s + SPAN])))
                        start.append(s)
                        single.append(not job["full"])
                        k1.append(a)
                        k2.append(c)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(start, pa.int32()), pa.array(single, pa.bool_()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["k1", "k2", "start", "single", "h1", "h2"])

        return one

    return map_batches(found.select("k1", "k2", "text", "jobs").where(F.size("jobs") > 0), make, "k1 long, k2 long, start int, single boolean, h1 long, h2 long")


def _removed(ranges: list[dict] | None, starts: list[int] | None, n: int) -> np.ndarray:
    """Which of a text's n words are covered."""
    turn = np.zeros(n + 1, np.int64)
    if ranges:
        np.add.at(turn, [r["lo"] for r in ranges], 1)
        np.add.at(turn, [min(n, r["hi"] + SPAN) for r in ranges], -1)
    if starts:
        np.add.at(turn, starts, 1)
        np.add.at(turn, [s + SPAN for s in starts], -1)
    return np.cumsum(turn[:n]) > 0


def _finish(found: DataFrame) -> DataFrame:
    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            removed, kept = [], []
            for raw, ranges, starts in zip(as_bytes(b.column("text")), b.column("ranges").to_pylist(), b.column("starts").to_pylist(), strict=True):
                words = raw.split()
                gone = _removed(ranges, starts, len(words))
                text = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(text).hexdigest())
            return pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["k1", "k2", "n_removed", "kept_sha256"])

        return one

    return map_batches(found, make, "k1 long, k2 long, n_removed long, kept_sha256 string")


def remove_repeats(spark: SparkSession, docs: DataFrame, batches: int = BATCHES, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text), which enters the index in batches.

    index: one that FingerprintIndex.open gave, to go on with; the caller commits it. history: the documents (doc_id, text)
    that it holds, as they were; to be given unless it is new.
    """
    ready(spark)
    lasting = index is not None
    if not lasting:
        index = FingerprintIndex(spark)
    if index.runs["entries"] and history is None:
        raise ValueError("the index holds documents: their table has to be given as history")
    source = _source(docs)
    read = materialise(spark, _read(source), "repeats-blocks")
    blocks = read.withColumn("e", F.explode(F.arrays_zip("anchor", "block", "lo", "hi"))).select("k1", "k2", "e.*")
    earlier = index._union("places")
    shared = None
    for b in range(batches):
        part = index.add(blocks.where(F.pmod(F.xxhash64("k1", F.lit(41)), F.lit(batches)) == b).select("anchor", "block"))
        shared = part if shared is None else shared.union(part)
    entries = materialise(spark, index.entries(shared.distinct()), "repeats-entries")
    discard(spark, shared)
    place = ("k1", "k2", "lo", "hi")
    found = blocks.select("anchor", "block", *place, F.lit(True).alias("mine"))
    if earlier is not None:
        found = found.union(earlier.join(entries.select("anchor").distinct(), "anchor", "left_semi").select("anchor", "block", *place, F.lit(False)))
    marks = materialise(spark, found.join(entries, ["anchor", "block"]), "repeats-marks")
    discard(spark, entries)
    if lasting:
        index.add_places(blocks)
    else:
        index.close()

    # one document stands for each repeated block that others are compared with
    stands = marks.where("full AND emit").groupBy("anchor", "block").agg(F.min(F.struct(*place)).alias("p")).select("p.*", F.lit(True).alias("full"))
    jobs = marks.where("NOT full").select(*place, "full").union(stands).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi", "full")).alias("jobs"))
    ranges = marks.where("full AND mine").groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"), F.sum(F.col("hi") - F.col("lo") + 1).alias("windows"))
    keys = read.groupBy("k1", "k2").agg(F.max("n_words").alias("n_words"), F.count("*").alias("copies"))
    if earlier is not None:
        keys = keys.join(jobs.select("k1", "k2"), ["k1", "k2"], "full")
    marked = materialise(spark, keys.join(ranges, ["k1", "k2"], "left").join(jobs, ["k1", "k2"], "left").where("ranges IS NOT NULL OR jobs IS NOT NULL"), "repeats-documents")
    discard(spark, marks)

    # all windows of a text repeated: nothing of it is left, and its text isn't needed but for what it stands for
    gone = F.coalesce(F.col("windows") == F.col("copies") * (F.col("n_words") - (SPAN - 1)), F.lit(False))
    whole = marked.where(gone).select("k1", "k2", F.col("n_words").alias("n_removed"), F.lit(NOTHING).alias("kept_sha256"))
    needed = marked.withColumn("gone", gone | F.col("copies").isNull()).where("NOT gone OR jobs IS NOT NULL").drop("n_words", "windows", "copies")
    every = source.select("k1", "k2", "text")
    if earlier is not None:
        every = every.union(_source(history).select("k1", "k2", "text"))
    texts = materialise(spark, every.join(needed, ["k1", "k2"]), "repeats-texts")
    release(spark)

    window = materialise(spark, _windows(texts), "repeats-windows")
    twice = window.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2")
    starts = materialise(spark, window.where("single").join(twice, ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_set("start").alias("starts")), "repeats-starts")
    discard(spark, window)
    part = _finish(texts.where("NOT gone").select("k1", "k2", "text", "ranges").join(starts, ["k1", "k2"], "left"))
    results = whole.union(part).dropDuplicates(["k1", "k2"])
    out = read.select("doc_id", "k1", "k2", "n_words", "whole").join(results, ["k1", "k2"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
