import base64
import collections
import math
import random
import re

import public_tokenizers
import tiktoken
from conftest import ODD

import corpus_pipeline
from tileflow.llm import decontaminate, language_id, secrets

SF = "/root/testdata/sf0.001"


def thresholds(texts):
    """For each length class the p-value up to which the step-up rejects, over the tokens of all texts."""
    by_class = collections.defaultdict(list)
    for t in texts:
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", t):
            if secrets.encoding_of(m[0]) is not None:
                step = min(secrets.LAST_STEP, int(-math.log10(max(secrets.random_p(m[0]), 1e-300)) * secrets.STEPS))
                by_class[sum(len(m[0]) >= c for c in secrets.CLASSES)].append(10 ** (-step / secrets.STEPS))
    found = {}
    for k, p in by_class.items():
        p.sort()
        found[k] = max([x for j, x in enumerate(p, 1) if x <= secrets.Q * sum(y <= x for y in p) / len(p)], default=-1.0)
    return found


def redact(text, limits):
    """Every span, found by its definition, replaced; spans that overlap are one."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 12]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", text):
        if secrets.encoding_of(m[0]) is not None and 10 ** (-min(secrets.LAST_STEP, int(-math.log10(max(secrets.random_p(m[0]), 1e-300)) * secrets.STEPS)) / secrets.STEPS) <= limits[sum(len(m[0]) >= c for c in secrets.CLASSES)]:
            spans.append(m.span())
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def brute(rows, bench, model, encode):
    """The stages one after the other on a list of rows, near-duplicates by all pairs."""
    rows = [r for r in rows if (p := model.predict(r.text))[0] != "und" and p[1] >= corpus_pipeline.MIN_SCORE]
    sets = []
    for r in rows:
        w = r.text.encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(range(len(rows)), key=lambda k: rows[k].doc_id)
    for a, i in enumerate(order):
        for j in order[:a]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)), key=lambda k: rows[k].doc_id)
                root[y] = x
    rows = [r for k, r in enumerate(rows) if find(k) == k]
    whole = [b" " + b" ".join(decontaminate.words_of(b.text)) + b" " for b in bench]
    rows = [r for r in rows if not any(w in b" " + b" ".join(decontaminate.words_of(r.text)) + b" " for w in whole)]
    limits = thresholds([r.text for r in rows])
    return {r.doc_id: encode(redact(r.text, limits)) for r in rows}


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    model = language_id.fit(spark, docs.where(~language_id.held_out()).select("text", "lang"))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(x): int(y) for x, y in (line.split() for line in f if line.strip())}
    public = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = brute(docs.collect(), bench, model, public.encode_ordinary)
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    assert collections.Counter(n for n, _ in corpus_pipeline.STAGES).most_common(1)[0][1] == 1


def test_each_stage_stands_odd_rows(spark, docs):
    rng = random.Random(9)
    words = "the and of thing stone there with other from every river".split()
    rows = [(100 + k, " ".join(rng.choice(words) for _ in range(60))) for k in range(30)]
    from pyspark.sql import functions as F

    table = docs(ODD + rows, extra=True).withColumn("lang", F.when(F.col("doc_id") >= 100, "en"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == table.columns and out.dtypes == table.dtypes, name
        assert {r.doc_id for r in out.where("doc_id >= 100").collect()} == {i for i, _ in rows}, name
        assert stage(spark, table.limit(0), SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, table, SF)
    assert last.count() == table.count()
