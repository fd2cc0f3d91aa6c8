"""Language identification by one Bloom filter whose cells hold a bit for each language.

Training counts, over all labelled training texts, the character trigrams (lower-cased letters; a word's edge is one
symbol) of each language. A trigram belongs to a language where it occurs MIN_COUNT times or more, makes up SHARE of
the language's trigrams or more, and is not over 1 / RELATIVE times as frequent in another language (so a few
mislabelled texts don't spread a language's trigrams). It then sets the language's bit in HASHES cells.

One lookup ands a trigram's cells and returns all languages that contain it. A text's popcount h of a language among
its n trigrams is corrected for the false positives that the filter's fill predicts, (h - n f) / (1 - f) with f the
language's fill to the power HASHES. The largest corrected count decides, the first name at a tie; the score is that
count over n, from 0 to 1.

Size: 2 ** CELLS_LOG2 cells for each 64 languages, whatever the corpus; that filter is all that is broadcast. Counts
are added by key and never gathered.

Texts that are null or without a letter give `und` and 0, and so does every text where nothing could be learned. A text
with letters of which no trigram is known gets the language that most training rows have (the first name at a tie), with
a score of 0. Rows with a null lang teach nothing. Repeated rows each give a row. Only text is an input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tileflow.llm.common import discard, free_name, materialise, ready

CELLS_LOG2, HASHES, PLANE = 20, 3, 64
MIN_COUNT, SHARE, RELATIVE = 2, 1e-5, 0.05
UNDECIDED = "und"
#: Trigram counts that a task holds before it hands them on.
HELD = 300_000
_MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(text: str | None) -> np.ndarray:
    """The text's trigrams as integers; empty without a letter."""
    if not text:
        return np.empty(0, np.uint64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.where(letters()[c], c, 0)
    c = np.concatenate(([0], c, [0])).astype(np.uint64)
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    if len(c) < 3:
        return np.empty(0, np.uint64)
    return (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]


def cells_of(grams: np.ndarray) -> list[np.ndarray]:
    """A trigram's cells, one array for each hash."""
    mixed = grams ^ (grams >> np.uint64(31))
    return [(mixed * np.uint64(m)) >> np.uint64(64 - CELLS_LOG2) for m in _MULTIPLIERS[:HASHES]]


@dataclass
class Filter:
    languages: list[str]
    planes: list[np.ndarray]  # cells, 64 languages each
    prior: str = UNDECIDED  # for texts that say nothing

    def __post_init__(self) -> None:
        size = 1 << CELLS_LOG2
        self.false = np.array([(np.count_nonzero(self.planes[i // PLANE] & np.uint64(1 << i % PLANE)) / size) ** HASHES for i in range(len(self.languages))])

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = trigrams(text)
        n = len(grams)
        if not n or not self.languages:
            return UNDECIDED, 0.0
        cells = cells_of(grams)
        hits = np.empty(len(self.languages))
        for p, plane in enumerate(self.planes):
            masks = plane[cells[0]]
            for c in cells[1:]:
                masks = masks & plane[c]
            for i in range(p * PLANE, min(len(hits), (p + 1) * PLANE)):
                hits[i] = np.count_nonzero(masks & np.uint64(1 << i % PLANE))
        corrected = np.round(np.maximum(hits - n * self.false, 0) / (1 - self.false), 6)
        best = int(np.argmax(corrected))
        if corrected[best] <= 0:
            return self.prior, 0.0
        return self.languages[best], float(min(1.0, corrected[best] / n))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language, added up within the task."""
    held: dict[str, list[np.ndarray]] = {}
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def fold() -> None:
        for lang, arrays in held.items():
            grams, n = np.unique(np.concatenate(arrays), return_counts=True)
            if lang in counts:
                both, at = np.unique(np.concatenate([counts[lang][0], grams]), return_inverse=True)
                n = np.bincount(at, np.concatenate([counts[lang][1], n])).astype(np.int64)
                grams = both
            counts[lang] = grams, n
        held.clear()

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (grams, n) in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
        counts.clear()

    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(trigrams(text))
        fold()
        if sum(len(g) for g, _ in counts.values()) > HELD:
            yield from out()
    yield from out()


def fit(spark: SparkSession, training: DataFrame) -> Filter:
    """A filter from all rows (text, lang) whose lang isn't null."""
    ready(spark)
    labelled = training.where(F.col("lang").isNotNull())
    counts = materialise(spark, labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-trigrams")
    totals = {r.lang: r.total for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}  # one row a language
    languages = sorted(totals)
    if not languages:
        discard(spark, counts)
        return Filter([], [])
    rows = {r.lang: r.n for r in labelled.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    prior = min(languages, key=lambda x: (-rows[x], x))
    index = F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.struct(F.lit(i).alias("i"), F.lit(float(totals[lang])).alias("total")))])
    shares = counts.where(F.col("n") >= MIN_COUNT).withColumn("at", index[F.col("lang")]).select("gram", F.col("at.i").alias("i"), (F.col("n") / F.col("at.total")).alias("share")).where(F.col("share") >= SHARE)
    by_gram = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("i", "share")).alias("in"))  # at most one entry a language
    kept = by_gram.select("gram", F.explode(F.filter("in", lambda x: x["share"] >= F.col("top") * RELATIVE)).alias("x")).select("gram", "x.i")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, i = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            mask = (np.uint64(1) << (i % PLANE).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(i // PLANE, HASHES), pa.int32()), pa.array(np.concatenate(cells_of(grams)).astype(np.int32)), pa.array(np.tile(mask, HASHES))], ["plane", "cell", "mask"])

    found = kept.mapInArrow(cells, "plane int, cell int, mask long").groupBy("plane", "cell").agg(F.bit_or("mask").alias("mask")).toArrow()  # a row a cell: bounded by the filter
    planes = [np.zeros(1 << CELLS_LOG2, np.uint64) for _ in range((len(languages) - 1) // PLANE + 1)]
    which, cell, mask = (found.column(c).to_numpy() for c in ("plane", "cell", "mask"))
    for p, plane in enumerate(planes):
        plane[cell[which == p]] = mask[which == p].view(np.uint64)
    discard(spark, counts)
    return Filter(languages, planes, prior)


def predict(spark: SparkSession, docs: DataFrame, model: Filter, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the predicted language and its score added; all rows and columns stay."""
    ready(spark)
    shared = spark.sparkContext.broadcast((model.languages, [p.tobytes() for p in model.planes], model.prior))
    text = free_name(docs, "text_read")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, planes, prior = shared.value
        filled = Filter(languages, [np.frombuffer(p, np.uint64) for p in planes], prior)
        for b in batches:
            i = b.schema.names.index(text)
            pairs = [filled.predict(t) for t in b.column(i).to_pylist()]
            rest = [(n, c) for j, (n, c) in enumerate(zip(b.schema.names, b.columns, strict=True)) if j != i]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array([p for p, _ in pairs], pa.string()), pa.array([s for _, s in pairs], pa.float64())], [n for n, _ in rest] + [lang_col, score_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return docs.withColumn(text, F.col("text").cast("string")).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; null ids are in training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that aren't held out."""
    model = fit(spark, docs.where(~held_out()).select("text", "lang"))
    return predict(spark, docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text"), model).drop("text")
