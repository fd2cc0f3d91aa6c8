"""Token counts without tokens: the Viterbi path of a unigram vocabulary, of which only score and length are kept.

An Aho-Corasick automaton over the vocabulary lists, at each end position, every piece that ends there; dynamic
programming carries the best score and the number of pieces of the path that reaches it.

Tie rules are those of the tokenizers library's Unigram model (double precision, scores added from the left): for one
end, pieces are tried from the longest to the shortest and a later one wins only if its score is strictly higher. A
character that is no piece itself may be taken as unknown, at the lowest score less UNKNOWN_PENALTY; neighbouring
unknown characters are one token, or with byte fallback one token for each of their UTF-8 bytes.

Texts are cut as a Metaspace pre-tokenizer cuts them: each space becomes U+2581, which begins a word; a text that
doesn't begin with it gets one in front. Words are independent, so counts of frequent words are kept in a bounded
cache. Null counts as empty and has no tokens; repeated rows each give a row.
"""

from __future__ import annotations

from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.llm.common import Memo, map_batches, ready

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


class Counter:
    """Counts the pieces of the best segmentation of each word."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        names = {p for p, _ in vocabulary}
        self.byte_fallback = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.word = Memo(self.count)

    def count(self, word: str) -> tuple[int, float]:
        """Pieces and score of the word's best segmentation."""
        n = len(word)
        score: list[float | None] = [0.0] + [None] * n
        pieces = [0] * (n + 1)
        unknown = [False] * (n + 1)
        at, known = -1, False
        matches = self.automaton.iter(word)
        m = next(matches, None)
        for end in range(1, n + 1):
            best, single = None, False
            while m is not None and m[0] + 1 == end:  # from the longest to the shortest
                length, s = m[1]
                single |= length == 1
                before = score[end - length] + s
                if best is None or before > best:
                    best, pieces[end] = before, pieces[end - length] + 1
                m = next(matches, None)
            if not single:
                before = score[end - 1] + self.unknown
                if best is None or before > best:
                    best, unknown[end] = before, True
                    cost = len(word[end - 1].encode()) if self.byte_fallback else not unknown[end - 1]
                    pieces[end] = pieces[end - 1] + cost
            score[end] = best
        return pieces[n], score[n]

    def count_text(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        words = text.replace(SPACE, " ").split(" ")
        if text[0] in (" ", SPACE):
            del words[0]
        pairs = [*map(self.word.__getitem__, [SPACE + w for w in words])]
        return sum(p for p, _ in pairs), sum(s for _, s in pairs)


def zipf_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file, scored as log-probabilities by Zipf's law over their ids; control pieces aren't among them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), -log(i + 1)) for i in range(len(model)) if not model.is_control(i) and not model.is_unknown(i)]


@lru_cache(2)
def counter(model_path: str) -> Counter:
    return Counter(zipf_vocabulary(model_path))


def count_documents(spark: SparkSession, docs: DataFrame, model_path: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens and the path's score. model_path is at the same place on every machine; no shuffle."""
    ready(spark)

    def make():
        c = counter(model_path)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            pairs = [c.count_text(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in pairs], pa.int64()), pa.array([s for _, s in pairs], pa.float64())], ["doc_id", "n_tokens", "score"])

        return one

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, n_tokens long, score double")
