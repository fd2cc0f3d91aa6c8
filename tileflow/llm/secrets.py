"""Secret scans: fixed patterns, and a randomness test battery for every long token.

Base spans come from three patterns (KINDS). The battery adds spans of kind "random": each maximal run of
[A-Za-z0-9+/_-] of MIN_TOKEN characters or more, with up to two "=" behind it, is given the smallest alphabet of
ENCODINGS that holds it (trailing "=" aside) and tested against the hypothesis that it was written. So the value of an
assignment and a run inside any other base span are tested as well; a random span may lie beside or across a base one.

* the p-value is the likelihood of the token as written over that as a uniform draw from its alphabet. Under any one of
  the models of writing it is under a with probability a at most (Markov's inequality), at every length, so it needs no
  margins; the largest likelihood of all models counts. Models: kinds of characters (small, capital, digit, sign) that
  stay the same with a probability of STAY or change as in words with capitals (CAPITALS), letters by their frequency in
  text; of letters alone, vowels and consonants that follow each other as in words of Latin script (SPOKEN), and such
  words in which a pair of letters comes again (ECHO); and characters that repeat, follow or precede the one up to LAGS
  places back.
* chi-squared uniformity, runs above and below the alphabet's middle and serial correlation of neighbours each have to
  agree with a uniform draw: beyond GATE standard deviations the p-value is 1.

False discoveries are held at Q by Benjamini and Hochberg's step-up within each
length class, over the p-values of the whole corpus: a first pass counts them in a fixed grid (p rounded up to it), a
second applies the thresholds. Tokens of digits alone, of both +/ and -_, or under MIN_TOKEN characters aren't tested.

Texts: null counts as empty; bytes that aren't UTF-8 count as U+FFFD; no spans give empty strings, whose SHA-256 is that
of no bytes. An empty table gives an empty result. Repeated rows each give a row and count each in the step-up. Offsets
are code points, ends exclusive. The work is linear in the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.llm.common import free_name, map_batches, ready

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
MIN_TOKEN = 20

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: By size; a token takes the first that holds all its characters.
ENCODINGS = {
    "base26": _LOWER,
    "BASE26": _UPPER,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base52": _UPPER + _LOWER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_ORDERS = {name: {c: i for i, c in enumerate(a)} for name, a in ENCODINGS.items()}
_SETS = {name: frozenset(a) for name, a in ENCODINGS.items()}
_WORDS = ("passw", "secret", "token", "api")

GATE, Q = 3.5, 0.05
#: Models of writing: probabilities that the next character is of the same kind, places back that a pattern may repeat, the probability that it does.
STAY, LAGS, REPEATS = (0.8, 0.95), 16, 0.9
#: And of the kind after a small letter, a capital, a digit and a sign in words that begin with capitals.
CAPITALS = ((0.74, 0.2, 0.03, 0.03), (0.85, 0.09, 0.03, 0.03), (0.03, 0.15, 0.77, 0.05), (0.25, 0.4, 0.3, 0.05))
#: Letters in running text, a to z, in thousandths (English, German, French and Spanish roughly pooled).
_TEXT = (83, 15, 31, 42, 141, 14, 19, 32, 72, 3, 7, 43, 27, 76, 66, 22, 5, 66, 68, 75, 35, 11, 11, 3, 12, 6)
#: In words, the probability of a vowel after a consonant and of a consonant after a vowel; pairs of letters that come again.
SPOKEN, ECHO = (0.42, 0.72), 0.3
_VOWELS = frozenset("aeiouy")
#: Lengths at which a new class begins, and steps of the p-value grid for a power of ten.
CLASSES, STEPS, LAST_STEP = (20, 28, 36, 48, 64, 96, 160), 20, 400

_IS_HEX = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_IS_TOKEN = bytes(120 if chr(b) in _DIGITS + _LOWER + _UPPER + "+/_-" else 32 for b in range(256))

Span = tuple[int, int, int]


def _within() -> dict[str, tuple[int, float]]:
    """Each character's kind, and its log probability among those of its kind: letters three parts by text, one part alike."""
    found = {c: (2, math.log(1 / 10)) for c in _DIGITS} | {c: (3, math.log(1 / 4)) for c in "+/-_"}
    for kind, letters in enumerate((_LOWER, _UPPER)):
        found |= {c: (kind, math.log(0.75 * n / sum(_TEXT) + 0.25 / 26)) for c, n in zip(letters, _TEXT, strict=True)}
    return found


_WITHIN = _within()
_CHANGES = [[[math.log(x) for x in row] for row in m] for m in (*[[[p if i == j else (1 - p) / 3 for j in range(4)] for i in range(4)] for p in STAY], CAPITALS)]


def spoken(body: str) -> float:
    """The log likelihood of letters as in words: vowels and consonants in turn, each by its frequency in text, and at every
    place, with a probability of ECHO, the letter that followed the same one earlier in the token."""
    low = body.lower()
    frequency = dict(zip(_LOWER, _TEXT, strict=True))
    total = {True: sum(n for c, n in frequency.items() if c in _VOWELS), False: sum(n for c, n in frequency.items() if c not in _VOWELS)}
    after: dict[str, str] = {}
    score, last = math.log(1 / 2), None
    for c in low:
        vowel = c in _VOWELS
        p = (0.85 * frequency[c] / total[vowel] + 0.15 / (6 if vowel else 20)) * (0.5 if last is None else (SPOKEN[1] if last in _VOWELS else SPOKEN[0]) if vowel != (last in _VOWELS) else 1 - (SPOKEN[1] if last in _VOWELS else SPOKEN[0]))
        if last is not None:
            if last in after:
                p = (1 - ECHO) * p + ECHO * (after[last] == c)
            after[last] = c
        score += math.log(p)
        last = c
    # capitals: none, all, or the first of a word of eight letters or so
    high = sum(c != d for c, d in zip(body, low, strict=True))
    return score + (0.0 if high in (0, len(body)) else high * math.log(1 / 8) + (len(body) - high) * math.log(7 / 8))


def written(body: str, values: list[int], size: int) -> float:
    """The largest log likelihood that a model of writing gives; values: the characters' places in an alphabet of so many."""
    kinds = [_WITHIN[c][0] for c in body]
    by_kind = sum(_WITHIN[c][1] for c in body) + math.log(1 / 4) + max(sum(m[a][b] for a, b in zip(kinds, kinds[1:], strict=False)) for m in _CHANGES)
    hit, miss, one = math.log(REPEATS / 3), math.log((1 - REPEATS) / size), math.log(1 / size)
    patterns = []
    for lag in range(1, min(LAGS, len(values) // 2) + 1):
        hits = sum(abs(a - b) <= 1 for a, b in zip(values, values[lag:], strict=False))
        patterns.append(lag * one + hits * hit + (len(values) - lag - hits) * miss)
    if body.isalpha():
        patterns.append(spoken(body))
    return max(by_kind, *patterns)


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that holds the token without its padding; None for a token without letters, of letters and signs alone, or of both +/ and -_."""
    body = token.rstrip("=")
    seen = frozenset(body)
    if not any(c.isalpha() for c in seen) or not (body.isalpha() or any(c.isdigit() for c in seen)):
        return None
    return next((name for name, a in _SETS.items() if seen <= a), None)


def random_p(token: str) -> float:
    """The battery's p-value: small where the token is a likely uniform draw and unlikely writing; 1 without an encoding."""
    name = encoding_of(token)
    if name is None:
        return 1.0
    order, size = _ORDERS[name], len(ENCODINGS[name])
    body = token.rstrip("=")
    values = [order[c] for c in body]
    n = len(values)
    counts = [0] * size
    for v in values:
        counts[v] += 1
    chi = sum(c * c for c in counts) * size / n - n
    high = [v >= size / 2 for v in values]
    n1 = sum(high)
    n0 = n - n1
    if not n1 or not n0:
        return 1.0
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    mean = 2 * n1 * n0 / n + 1
    sd = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    m = sum(values) / n
    spread = sum((v - m) ** 2 for v in values)
    r = sum((a - m) * (b - m) for a, b in zip(values, values[1:], strict=False)) / spread if spread else 1.0
    if (chi - (size - 1)) / math.sqrt(2 * (size - 1)) > GATE or abs(runs - mean) / sd > GATE or abs(r) * math.sqrt(n) > GATE:
        return 1.0
    return math.exp(min(0.0, written(body, values, size) + n * math.log(size)))


def base_spans(text: str, raw: bytes) -> list[Span]:
    """(start, kind, end) of the fixed patterns, by start and kind. raw: the text's UTF-8."""
    found: list[Span] = []
    low = raw.lower()
    if any(w.encode() in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"x" * 16 in raw.translate(_IS_HEX):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, raw: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, length class, step of the p-value grid) of the tokens that have an alphabet."""
    if b"x" * MIN_TOKEN not in raw.translate(_IS_TOKEN):
        return
    for m in TOKEN.finditer(text):
        s, e = m.span()
        if encoding_of(m[0]) is not None:
            yield s, e, sum(e - s >= c for c in CLASSES), min(LAST_STEP, int(-math.log10(max(random_p(m[0]), 1e-300)) * STEPS))


def thresholds(counts: dict[tuple[int, int], int], tests: dict[int, int], q: float = Q) -> dict[int, int]:
    """For each length class, the first step of the grid that counts as a discovery (Benjamini and Hochberg)."""
    found = {}
    for k, m in tests.items():
        below = 0
        for step in range(LAST_STEP, -1, -1):
            below += counts.get((k, step), 0)
            if below and 10 ** (-step / STEPS) <= q * below / m:
                found[k] = step
    return found


def fit_thresholds(spark: SparkSession, docs: DataFrame) -> dict[int, int]:
    """First pass: the corpus's p-values, counted on the grid; at most 8 classes x 402 steps come to the driver."""
    ready(spark)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n: dict[tuple[int, int], int] = {}
            for raw in batch.column(0).to_pylist():
                if raw and b"x" * MIN_TOKEN in raw.translate(_IS_TOKEN):
                    for _, _, k, step in candidates(raw.decode(errors="replace"), raw):
                        n[k, step] = n.get((k, step), 0) + 1
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in n], pa.int32()), pa.array([s for _, s in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["k", "step", "n"])

        return one

    rows = map_batches(docs.select(F.col("text").cast("string").cast("binary")), make, "k int, step int, n long").groupBy("k", "step").agg(F.sum("n").alias("n")).collect()
    tests: dict[int, int] = {}
    for r in rows:
        tests[r.k] = tests.get(r.k, 0) + r.n
    return thresholds({(r.k, r.step): r.n for r in rows}, tests)


def spans_of(raw: bytes | None, first: dict[int, int]) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with what the battery adds."""
    if not raw:
        return [], []
    text = raw.decode(errors="replace")
    base = base_spans(text, raw)
    more = [(s, 3, e) for s, e, k, step in candidates(text, raw) if step >= first.get(k, LAST_STEP + 1)]
    return base, sorted(base + more)


def named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCAN_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def scan_documents(spark: SparkSession, docs: DataFrame, first: dict[int, int] | None = None) -> DataFrame:
    """One row per row of docs: counts by kind, the hash of the base spans and all spans as kind:start:end."""
    ready(spark)
    first = fit_thresholds(spark, docs) if first is None else first

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n: list[list[int]] = [[], [], [], []]
            hashes, spans = [], []
            for raw in batch.column(1).to_pylist():
                base, every = spans_of(raw, first)
                for k in range(4):
                    n[k].append(sum(x[1] == k for x in every))
                hashes.append(hashlib.sha256(named(base).encode()).hexdigest())
                spans.append(named(every))
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in n], pa.array(hashes, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

        return one

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")), make, SCAN_SCHEMA)


def redactor(first: dict[int, int], mask: str = "[secret]") -> Callable[[bytes | None], str | None]:
    """A function that puts mask in the place of every span; spans that overlap become one."""

    def redact(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        text = raw.decode(errors="replace")
        out, at = [], 0
        for s, _, e in spans_of(raw, first)[1]:
            if s >= at:
                out += [text[at:s], mask]
            at = max(at, e)
        return "".join([*out, text[at:]])

    return redact


def redact_documents(spark: SparkSession, docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every secret in text replaced by mask; rows and other columns stay, n_chars (if there) follows the text."""
    ready(spark)
    first = fit_thresholds(spark, docs)
    raw = free_name(docs, "raw_text")
    rest = [c for c in docs.columns if c != "text"]

    def make():
        redact = redactor(first, mask)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            i = batch.schema.names.index(raw)
            texts = pa.array([redact(x) for x in batch.column(i).to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays([c for j, c in enumerate(batch.columns) if j != i] + [texts], [*rest, "text"])

        return one

    schema = docs.select(*rest, F.col("text").cast("string").alias("text")).schema
    out = docs.select(*rest, F.col("text").cast("string").cast("binary").alias(raw)).mapInArrow(_per_batch(make), schema)
    changed = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.withColumns(changed).select(*docs.columns)


def _per_batch(make):
    def run(batches):
        one = make()
        for b in batches:
            yield one(b)

    return run
