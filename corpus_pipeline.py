"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given. The first four return the columns of docs;
what they decide takes effect:

language_id        drops documents whose language can't be told: no letter, or under MIN_SCORE of their trigrams known
                   in the best language (learned from the documents that aren't held out)
near_duplicates    keeps one document of each group of near-duplicates (five words, similarity 0.8)
decontaminate      drops documents into which a benchmark item leaks
secrets            replaces secrets by a mask and corrects n_chars
byte_bpe           gives each document's tokens: doc_id, n_tokens, ids_sha256, decoded_sha256, ids

Null and empty texts have no language and leave at the first stage. Repeated rows are near-duplicates of each other.
Columns beyond those of documents stay until the last stage; an empty table gives empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.llm import byte_bpe, decontaminate, language_id, minhash, secrets
from tileflow.llm.common import discard, free_name, materialise, only_results, table

MIN_SCORE = 0.3
WORDS, PERCENT = 5, 80


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(spark, docs.where(~language_id.held_out()).select("text", "lang"))
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    found = language_id.predict(spark, docs, model, lang, score)
    return found.where((F.col(lang) != language_id.UNDECIDED) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(spark, docs, WORDS, PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(spark, docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_documents(spark, docs, path, public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("language_id", identify),
    ("near_duplicates", deduplicate),
    ("decontaminate", without_benchmark),
    ("secrets", without_secrets),
    ("byte_bpe", encode),
]

#: Language models and tokenizers can't be said in SQL; tests/llm has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with only_results(spark) as keep:
            done = materialise(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(done)
        if k:
            discard(spark, docs)
        docs = done
    return docs
