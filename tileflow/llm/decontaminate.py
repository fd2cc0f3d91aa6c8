"""Benchmark decontamination: BM25 with block-max WAND over the test items, queried by every passage of every text.

Words are lower-cased runs without ASCII punctuation. The index holds, for each term, its items in order with their
impact: the BM25 contribution (K1, B; inverse frequencies over all items) divided by the item's score for its own
words, so an item scores 1 for a passage with all its words. Postings are cut into blocks of BLOCK items with their
largest impact.

Every text is cut into passages of two strides, one stride apart; a stride is the longest item's length (MIN_STRIDE at
least), so a copied item lies whole in some passage. A passage is a query of its distinct words. First the block
maxima of its words are added for each block, for many passages at once; a passage with no block of THRESHOLD or more
has no item of THRESHOLD and is done. The others go through block-max WAND, which returns all items of THRESHOLD or
more: the pivot is where the terms' largest impacts reach it, the blocks' maxima must too, else cursors jump past the
block.

Verification: an item's answer is what follows its last sentence end that leaves SHINGLE words on both sides (without
one, its last third); its question is the rest. A leak needs OVERLAP of the distinct SHINGLE-word runs of the question
and OVERLAP of the answer's in the passage. Items too short to have both are one question; of fewer than SHINGLE words
the whole sequence is the one run.

Size: items are dealt into shards by their length (a class for each factor of LENGTHS, so a few long items don't widen
the passages of the others) and by hash into SHARD_WORDS words at most in the mean. A shard's index is built in a task,
into arrays (a 64-bit hash for a run), and is what is broadcast: one shard at a time, matched with all texts, its leaks
written and its broadcast destroyed before the next. So the benchmark may grow; time grows with the number of shards.
Null or wordless items leak into nothing; null
or empty texts have no leak. Items with the same id are judged each, their leaks have that id. Repeated rows each
give their leaks. An empty benchmark gives no leaks.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tileflow.llm.common import Memo, discard, free_name, materialise, ready

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.8, 5
BLOCK, MIN_STRIDE = 4, 64
SHARD_WORDS, LENGTHS = 1 << 20, (512, 4096, 32768, 1 << 62)
#: Words of texts that are scored together; sums and postings that are held for that.
WORDS_AT_ONCE, SUMS_AT_ONCE, POSTINGS_AT_ONCE = 200_000, 4 << 20, 2 << 20

#: Bytes of an index in one row on its way to the driver.
PIECE = 8 << 20

_SPACE = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
_END = re.compile(r"[.!?]\s")
LEAK = T.StructType([T.StructField("item_id", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in ("score", "question", "answer")]])


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_SPACE).split() if text else []


def runs_of(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the runs of so many words, of the whole sequence if it has fewer."""
    if not words:
        return np.empty(0, np.uint64)
    starts = range(max(1, len(words) - size + 1))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[k : k + size])) for k in starts), np.uint64, len(starts)))


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    words = words_of(text)
    if len(words) < 2 * SHINGLE:
        return words, []
    for m in reversed([*_END.finditer(text)]):
        q, a = words_of(text[: m.end()]), words_of(text[m.end() :])
        if len(a) >= SHINGLE and len(q) >= SHINGLE:
            return q, a
    cut = min(len(words) - SHINGLE, ceil(len(words) * 2 / 3))
    return words[:cut], words[cut:]


class Index:
    """One shard's items as arrays. frequencies: in how many of all n items each of the shard's words occurs; mean: words an item."""

    def __init__(self, items: list[tuple[int, str]], frequencies: dict[bytes, int], n: int, mean: float):
        self.ids = np.array([i for i, _ in items], object)  # may be null
        self.words = sorted(frequencies)
        terms = {t: k for k, t in enumerate(self.words)}
        postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.stride, parts, self.part_words = MIN_STRIDE, [], []
        for d, (_, text) in enumerate(items):
            bag = Counter(words_of(text))
            size = sum(bag.values())
            self.stride = max(self.stride, size)
            term = np.fromiter((terms[t] for t in bag), np.int32, len(bag))
            tf, df = np.fromiter(bag.values(), float, len(bag)), np.fromiter((frequencies[t] for t in bag), float, len(bag))
            impact = np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
            postings.append((term, np.full(len(bag), d, np.int32), impact / (impact.sum() or 1.0)))
            for part in question_and_answer(text):
                parts.append(runs_of(part))
                self.part_words.append(min(len(part), SHINGLE))
        term, item, impact = (np.concatenate([p[k] for p in postings]) for k in range(3)) if postings else (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0))
        order = np.lexsort((item, term))
        term, self.item, self.impact = term[order], item[order], impact[order]
        self.at = np.searchsorted(term, np.arange(len(terms) + 1))
        self.most = np.array([self.impact[a:b].max(initial=0) for a, b in zip(self.at, self.at[1:], strict=False)])
        self.part_at = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
        self.runs = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        # by term and block of items: CSR of block numbers and largest impacts
        self.blocks = max(1, ceil(len(items) / BLOCK))
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (self.item[1:] // BLOCK != self.item[:-1] // BLOCK)))) if len(term) else np.empty(0, int)
        self.block_number = self.item[first] // BLOCK
        self.block_most = np.maximum.reduceat(self.impact, first) if len(first) else np.empty(0)
        self.block_at = np.searchsorted(first, self.at)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("terms", "order", "most_in")}

    def open(self) -> Index:
        """Makes what a worker looks words and postings up in; the latter for the terms it meets."""
        self.terms = {t: k for k, t in enumerate(self.words)}
        self.order = Memo(lambda t: self.item[self.at[t] : self.at[t + 1]].tolist(), 20_000)
        between = lambda t: slice(self.block_at[t], self.block_at[t + 1])
        self.most_in = Memo(lambda t: dict(zip(self.block_number[between(t)].tolist(), self.block_most[between(t)].tolist(), strict=True)), 20_000)
        return self

    def _add_bounds(self, total: np.ndarray, cell: np.ndarray, term: np.ndarray, sign: int) -> None:
        """Adds to total (cells x blocks), for distinct (cell, term), the block maxima; a bounded number of postings at a time."""
        sizes = self.block_at[term + 1] - self.block_at[term]
        upto = np.cumsum(sizes)
        s = 0
        while s < len(term):
            e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + POSTINGS_AT_ONCE, "right")))
            n = sizes[s:e]
            at = np.repeat(self.block_at[term[s:e]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            where = np.repeat(cell[s:e], n) * self.blocks + self.block_number[at]
            total += sign * np.bincount(where, self.block_most[at], total.size).reshape(total.shape)
            s = e

    def may_score(self, cell: np.ndarray, term: np.ndarray, cells: int, threshold: float) -> np.ndarray:
        """For distinct (cell, term) in order, which cells could hold with the next one an item of the threshold, by block maxima."""
        pairs = cell * len(self.words) + term
        later = np.searchsorted(pairs, pairs + len(self.words))
        again = pairs[np.minimum(later, len(pairs) - 1)] == pairs + len(self.words) if len(pairs) else np.empty(0, bool)
        found = np.zeros(cells, bool)
        step = max(1, SUMS_AT_ONCE // self.blocks)
        for s in range(0, cells, step):
            rows = min(step, cells - s)
            a, b = np.searchsorted(cell, [s, s + rows + 1])  # and the cell behind
            total = np.zeros((rows + 1, self.blocks))
            self._add_bounds(total, cell[a:b] - s, term[a:b], 1)
            total[:-1] += total[1:].copy()
            twice = a + np.flatnonzero(again[a:b])  # in both cells, but once in the query
            self._add_bounds(total, cell[twice] - s, term[twice], -1)
            found[s : s + rows] = total[:rows].max(axis=1) >= threshold - 1e-9
        return found

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items of the threshold or more for a query of distinct terms: block-max WAND."""
        cursors = [[self.order[t][0], 0, t] for t in terms if self.at[t] < self.at[t + 1]]
        found = []
        threshold -= 1e-9

        def move(c: list[int], item: int) -> None:
            items = self.order[c[2]]
            c[1] = bisect_left(items, item, c[1])
            c[0] = items[c[1]] if c[1] < len(items) else -1

        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.most[c[2]]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            bound = sum([self.most_in[c[2]].get(block, 0.0) for c in cursors[: pivot + 1]])
            if bound < threshold:
                # nothing in this block before the next cursor's item can reach it
                to = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                for c in cursors[: pivot + 1]:
                    move(c, max(to, item + 1))
            elif cursors[0][0] == item:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    score += self.impact[self.at[c[2]] + c[1]]
                if score >= threshold:
                    found.append((item, float(score)))
                for c in cursors[: pivot + 1]:
                    move(c, item + 1)
            else:
                for c in cursors[:pivot]:
                    if c[0] < item:
                        move(c, item)
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def _verify(self, words: list[bytes], terms: list[int], best: dict[int, tuple[float, float, float]]) -> None:
        here: dict[int, np.ndarray] = {}
        for item, score in self.wand(terms, THRESHOLD):
            shares = []
            for part in (2 * item, 2 * item + 1):
                runs, size = self.runs[self.part_at[part] : self.part_at[part + 1]], self.part_words[part]
                if size and size not in here:
                    here[size] = runs_of(words, size)
                shares.append(len(np.intersect1d(runs, here[size], assume_unique=True)) / len(runs) if size else 1.0)
            if min(shares) >= OVERLAP:
                best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (score, *shares))

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text the items that leak into it."""
        out: list[list[dict]] = []
        held: list[list[bytes]] = []
        size = 0
        for t in texts:
            held.append(words_of(t))
            size += len(held[-1])
            if size >= WORDS_AT_ONCE:
                out += self._leaks(held)
                held, size = [], 0
        return out + self._leaks(held)

    def _leaks(self, texts: list[list[bytes]]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        if not self.words or not texts:
            return out
        sizes = np.array([len(t) for t in texts])
        cells = sizes // self.stride + 1  # a last, empty cell keeps neighbours of one text apart
        start = np.concatenate(([0], np.cumsum(cells + 1)))
        place = np.concatenate([np.arange(n) // self.stride + s for n, s in zip(sizes, start, strict=False)])
        known = np.concatenate([np.fromiter(map(self.terms.get, t, repeat(-1)), np.int64, len(t)) for t in texts])
        is_known = known >= 0
        pairs = np.unique(place[is_known] * len(self.words) + known[is_known])
        cell, term = pairs // len(self.words), pairs % len(self.words)
        for c in np.flatnonzero(self.may_score(cell, term, int(start[-1]), THRESHOLD)):
            d = int(np.searchsorted(start, c, "right")) - 1
            s = (int(c) - int(start[d])) * self.stride
            words = texts[d][s : s + 2 * self.stride]
            a, b = np.searchsorted(cell, [c, c + 2])
            best: dict[int, tuple[float, float, float]] = {}
            self._verify(words, np.unique(term[a:b]).tolist(), best)
            for item, (score, q, ans) in best.items():
                out[d].append({"item_id": self.ids[item], "score": score, "question": q, "answer": ans})
        for k, found in enumerate(out):
            if len(found) > 1:  # of several passages the best
                found.sort(key=lambda x: (x["item_id"] is None, x["item_id"] or 0, -x["score"]))
                out[k] = [x for j, x in enumerate(found) if not j or found[j - 1]["item_id"] != x["item_id"]]
        return out


def build_indexes(spark: SparkSession, benchmark: DataFrame) -> Iterator[Broadcast]:
    """The index of each shard of the items (item_id, text), as a broadcast that is destroyed when the next is asked for."""
    ready(spark)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.binary()))], ["item_id", "text", "words"])

    kind = F.when(F.lit(False), 0)
    for k, most in enumerate(LENGTHS):
        kind = kind.when(F.col("n") <= most, k)
    read = materialise(spark, items.mapInArrow(split, "item_id long, text string, words array<binary>").withColumn("n", F.size("words")).where("n > 0").withColumn("kind", kind), "benchmark")
    n, total = read.agg(F.count("*"), F.sum("n")).first()
    if not n:
        return
    frequencies = materialise(spark, read.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df")), "benchmark-words")
    kinds = {r.kind: r.words for r in read.groupBy("kind").agg(F.sum("n").alias("words")).collect()}  # a row a class of lengths
    for kind, words in sorted(kinds.items()):
        shards = ceil(words / SHARD_WORDS)
        for k in range(shards):
            part = read.where((F.col("kind") == kind) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k))
            known = part.select(F.explode("words").alias("word")).distinct().join(frequencies, "word").select(F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("string").alias("text"), "word", "df")
            rows = known.union(part.select("item_id", "text", F.lit(None).cast("binary"), F.lit(None).cast("long"))).repartition(1).sortWithinPartitions("item_id", "text", "word")

            def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                some: list[tuple[int, str]] = []
                df: dict[bytes, int] = {}
                for b in batches:
                    for i, text, word, count in zip(*[c.to_pylist() for c in b.columns], strict=True):
                        if word is None:
                            some.append((i, text))
                        else:
                            df[word] = count
                if some:
                    packed = pickle.dumps(Index(some, df, n, total / n))
                    pieces = [packed[s : s + PIECE] for s in range(0, len(packed), PIECE)]
                    for j, piece in enumerate(pieces):
                        yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([piece], pa.binary())], ["piece", "packed"])

            pieces = rows.mapInArrow(build, "piece int, packed binary").collect()  # a shard: bounded
            if pieces:
                shared = spark.sparkContext.broadcast(b"".join(bytes(r.packed) for r in sorted(pieces, key=lambda r: r.piece)))
                del pieces
                yield shared
    discard(spark, read, frequencies)


def with_leaks(spark: SparkSession, docs: DataFrame, shared: Broadcast, column: str = "leaks") -> DataFrame:
    """docs with a column of the shard's items that leak into text; all rows and columns stay."""
    ready(spark)
    text = free_name(docs, "text_read")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pickle.loads(shared.value).open()
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))
        for b in batches:
            i = b.schema.names.index(text)
            leaks = pa.array(found.leaks(b.column(i).to_pylist()), kind)
            rest = [(n, c) for j, (n, c) in enumerate(zip(b.schema.names, b.columns, strict=True)) if j != i]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + [leaks], [n for n, _ in rest] + [column])

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.ArrayType(LEAK))])
    return docs.withColumn(text, F.col("text").cast("string")).mapInArrow(run, schema)


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question, answer: a row for each item that leaks into a row of docs; clean documents have none."""
    out = None
    for shared in build_indexes(spark, benchmark):
        found = with_leaks(spark, docs.select(F.col("doc_id").cast("long"), "text"), shared).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
        found = materialise(spark, found, "leaks")
        shared.destroy()
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, score double, question double, answer double")


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs into which nothing leaks, with their columns."""
    column, before = free_name(docs, "leaks"), None
    for shared in build_indexes(spark, benchmark):
        docs = materialise(spark, with_leaks(spark, docs, shared, column).where(F.size(column) == 0).drop(column), "clean")
        shared.destroy()
        if before is not None:
            discard(spark, before)
        before = docs
    return docs
