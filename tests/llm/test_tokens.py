import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import ODD
from tokenizers import Tokenizer, models, pre_tokenizers

from tileflow.llm import byte_bpe, unigram_counts

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = list("ab 1'.\n\t  sé　 \x1c\x85漢🙂tllA▁ßthe_'s") + ["\r\n", "   ", "hello", "2024"]


def texts(n=1500, seed=1):
    rng = random.Random(seed)
    return ["", " ", "\n", "x" * 5000, " " * 300, "don't we'll I'd"] + ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_library_and_decode_back(reference):
    codec = byte_bpe.codec(PATH, public_tokenizers.PATTERN)
    for t in texts():
        assert codec.encode(t) == reference.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()


def test_every_character(reference):
    codec = byte_bpe.codec(PATH, public_tokenizers.PATTERN)
    for c in [*range(0, 0xD800, 7), *range(0xE000, 0x110000, 997), *range(0x2000, 0x2070)]:
        t = f"a{chr(c)}b 1{chr(c)}{chr(c)} "
        assert codec.encode(t) == reference.encode_ordinary(t)


def test_a_gap_in_the_ranks_is_refused():
    with pytest.raises(ValueError):
        byte_bpe.model_proto({bytes([b]): b + (b > 9) for b in range(256)})


def test_encode_documents(spark, docs, reference):
    rows = ODD + [(100 + k, t) for k, t in enumerate(texts(50))]
    out = byte_bpe.encode_documents(spark, docs(rows, extra=True), PATH, public_tokenizers.PATTERN, keep_ids=True).collect()
    expected = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, expected))
    assert byte_bpe.encode_documents(spark, docs([]), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("fallback", [True, False])
def test_counts_are_those_of_the_unigram_library(fallback):
    vocabulary = unigram_counts.zipf_vocabulary(PIECES)
    least = min(s for _, s in vocabulary)
    tokenizer = Tokenizer(models.Unigram([("<unk>", least), *vocabulary], unk_id=0, byte_fallback=fallback))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = unigram_counts.Counter(vocabulary, fallback)
    for t in texts(1500, 2):
        assert counter.count_text(t)[0] == len(tokenizer.encode(t).ids), repr(t)


def test_ties_keep_the_longest_last_piece():
    vocabulary = [("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -3.0), ("▁", -1.0)]
    tokenizer = Tokenizer(models.Unigram([("<unk>", -9.0), *vocabulary], unk_id=0))
    counter = unigram_counts.Counter(vocabulary)
    counter.unknown = -19.0
    for word in ("abc", "abcabc", "aabbcc", "xabcx", "xx"):
        assert counter.count(word)[0] == len(tokenizer.encode(word).ids), word


def test_count_documents(spark, docs):
    out = {r.doc_id: r.n_tokens for r in unigram_counts.count_documents(spark, docs(ODD, extra=True), PIECES).collect() if r.doc_id in (1, 2, 7)}
    one = unigram_counts.counter(PIECES).count_text("word")[0]
    assert out == {1: 0, 2: 0, 7: 3000 * one + unigram_counts.counter(PIECES).count_text("a ")[0] - unigram_counts.counter(PIECES).count_text("a")[0]}
    assert unigram_counts.count_documents(spark, docs([]), PIECES).count() == 0
