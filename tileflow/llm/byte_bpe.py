"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

No tokenizer is trained. The rank file's byte strings become pieces of a sentencepiece BPE model: each byte is
mapped to one printable character, the score is the negative rank, and normalisation is the identity. A text is cut
into pre-tokens by the vocabulary's pattern; each pre-token is encoded on its own, and ids are decoded by the
inverse mapping.

Texts: null counts as empty and gives no ids; the hash columns are then those of no bytes. Lone surrogates cannot
occur in Spark strings. Repeated rows each give a row. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.llm.common import Memo, map_batches, ready

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

# Fixed value: the white space of the pattern's \s, as Unicode's White_Space property has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where it prints in Latin-1, else the next from U+0100."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (chr(c) for c in range(256, 512))
    return [chr(b) if b in prints else next(others) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protocol-buffers field: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The ranks as a serialised sentencepiece BPE model whose ids are the ranks; an unknown piece follows them."""
    letters = byte_characters()
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[b] for b in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a rank: {missing[:5]}")
    pieces = []
    for rank, b in enumerate(order):
        name = "".join(letters[x] for x in b).encode()
        pieces.append(_field(1, _field(1, name) + _field(2, float(-rank)) + _field(3, 1)))
    unknown = "⁇unknown⁇"
    pieces.append(_field(1, _field(1, unknown.encode()) + _field(2, 0.0) + _field(3, 2)))
    n = len(order)
    none = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, n + 1) + _field(24, 0) + _field(40, n) + b"".join(_field(k, none) for k in (41, 42, 43)) + _field(45, unknown.encode())
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes whole texts; caches are bounded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        # The vocabulary's pattern means Unicode's White_Space; the regex module's \s also takes U+001C to U+001F.
        white = "".join(f"\\u{ord(c):04x}" for c in WHITE)
        inside = re.sub(r"\[\^([^\]]*)\\s([^\]]*)\]", lambda m: f"[^{m[1]}{white}{m[2]}]", pattern)
        self.pattern = regex.compile(inside.replace(r"\s", f"[{white}]").replace(r"\S", f"[^{white}]"))
        self.ranks = ranks
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.letters = dict(enumerate(byte_characters()))
        byte_of = {c: b for b, c in self.letters.items()}
        self.bytes_of = [bytes(map(byte_of.__getitem__, self.model.IdToPiece(i))) for i in range(len(ranks))]
        self.token = Memo(self._token, 300_000)

    def _token(self, token: str) -> bytes:
        raw = token.encode()
        rank = self.ranks.get(raw)
        ids = [rank] if rank is not None else self.model.EncodeAsIds(raw.decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        return b"".join(map(self.token.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the model's own pieces, each character mapped back to its byte."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode_documents(spark: SparkSession, docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens and the hashes of ids and of the decoded bytes; with keep_ids also ids, array<int>.

    path: the rank file, at the same place on every machine. Each row is one task's own work: no shuffle.
    """
    ready(spark)
    schema = SCHEMA + ", ids array<int>" * keep_ids

    def make():
        c = codec(path, pattern)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, hashes, decoded, lists = [], [], [], []
            for text in batch.column(1).to_pylist():
                packed = c.encode_bytes(text or "")
                ids = np.frombuffer(packed, "<u4")
                counts.append(len(ids))
                hashes.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids.tolist())).hexdigest())
                if keep_ids:
                    lists.append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        return one

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, schema)
