import random
import zlib

import numpy as np
import pytest
from conftest import ODD

from tileflow.llm import decontaminate, language_id, toxicity

WORDS = {"aa": "the and of thing stone there with other", "bb": "der die und nicht schon werden zwischen über", "cc": "что это как они только быть время если"}
SF = "/root/testdata/sf0.01"


def sentences(lang, rng, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.identify_documents(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) > 0.97 * len(out) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)


def test_language_edges_and_many_languages(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(100 + k, sentences(lang, rng, 30), lang) for k in range(60) for lang in WORDS]
    rows += [(i, t, None) for i, t in ODD] + [(50, "123 !? ...", "aa"), (51, "zzzz qqqq", None), (52, "Ω", None), (53, sentences("aa", rng, 30), "aa"), (54, sentences("aa", rng, 30), "aa"), (56, sentences("aa", rng, 30), "aa")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    out = language_id.identify_documents(spark, df)
    assert out.count() == len(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert got[50] == got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[51] == got[52] == ("aa", 0.0)  # letters, but none of the trigrams is known: the language of most training rows
    assert language_id.identify_documents(spark, df.limit(0)).count() == 0
    # 70 languages need a second plane of bits
    def invented(k):
        return " ".join("".join(chr(0x4E00 + 40 * k + rng.randrange(6)) for _ in range(4)) for _ in range(20))

    many = spark.createDataFrame([(k, invented(k % 70), f"l{k % 70:02}") for k in range(700)], "doc_id long, text string, lang string")
    model = language_id.fit(spark, many)
    assert len(model.planes) == 2 and len(model.languages) == 70
    assert sum(model.predict(invented(k))[0] == f"l{k:02}" for k in range(70)) >= 69


def test_trigrams_and_predictions_against_brute_force(spark):
    """Trigrams by regular expression, sets for the filter: the same languages but for a text with a tie or a false positive."""
    import collections
    import re

    docs = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]

    def grams(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        s = f" {' '.join(words)} "
        return [s[k : k + 3] for k in range(len(s) - 2)] if words else []

    counts = collections.defaultdict(collections.Counter)
    for r in docs:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts[r.lang].update(grams(r.text))
    for r in docs[:50]:
        assert len(language_id.trigrams(r.text)) == len(grams(r.text))
    share = {x: {g: n / c.total() for g, n in c.items() if n >= language_id.MIN_COUNT and n / c.total() >= language_id.SHARE} for x, c in counts.items()}
    top = collections.Counter()
    for s in share.values():
        for g, x in s.items():
            top[g] = max(top[g], x)
    known = {x: {g for g, y in s.items() if y >= top[g] * language_id.RELATIVE} for x, s in share.items()}
    out = {r.doc_id: r for r in language_id.identify_documents(spark, spark.createDataFrame(docs)).collect()}
    same = 0
    for r in docs:
        g = grams(r.text)
        hits = {x: sum(y in known[x] for y in g) for x in sorted(known)}
        best = max(hits, key=lambda x: hits[x]) if g else "und"
        same += out[r.doc_id].lang_pred == best and abs(out[r.doc_id].score - (hits[best] / len(g) if g else 0)) < 0.02
    assert same >= 0.99 * len(docs)


def test_filter_returns_the_languages_of_a_trigram():
    model = language_id.Filter(["a", "b"], [np.zeros(1 << language_id.CELLS_LOG2, np.uint64)])
    grams = {0: language_id.trigrams("hello"), 1: language_id.trigrams("world hello")}
    for i, g in grams.items():
        for c in language_id.cells_of(g):
            model.planes[0][c] |= np.uint64(1 << i)
    model.__post_init__()
    assert model.predict("world") == ("b", pytest.approx(1.0, abs=1e-3)) and model.predict("hello")[0] == "a"


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.classify_documents(spark, docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in out if r.toxic], [r for r in out if not r.toxic]
    assert sum(r.predicted for r in toxic) > 0.75 * len(toxic)
    assert sum(r.predicted for r in clean) < 0.02 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)


def test_toxicity_edges(spark, docs):
    rng = random.Random(2)
    rows = [(100 + k, sentences("aa", rng, 40) + (" you idiot" if k % 4 == 0 else "")) for k in range(800)]
    labels = spark.createDataFrame([(100 + k, int(k % 4 == 0)) for k in range(800)] + [(1, 1), (None, 1), (2, None), (999_999, 1)], "doc_id long, toxic int")
    table = docs(rows + ODD, extra=True)
    out = toxicity.classify_documents(spark, table, labels)
    got = {r.doc_id: r for r in out.collect() if r.doc_id and r.doc_id >= 100}
    assert out.count() == len(rows) + len(ODD)
    assert all(got[100 + k].predicted == (k % 4 == 0) for k in range(800))
    none = toxicity.classify_documents(spark, table, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    assert toxicity.classify_documents(spark, docs([]), labels).count() == 0


def test_labels_without_a_document_take_no_place_in_the_sample(spark, docs, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 300)
    rng = random.Random(5)
    rows = [(k, sentences("aa", rng, 40) + (" you idiot" if k % 4 == 0 else "")) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)] + [(k, 1) for k in range(10_000, 13_000)], "doc_id long, toxic int")
    some = lambda df: toxicity.fit(spark, docs(rows), df)
    all_labels, those = some(labels), some(labels.where("doc_id < 300"))
    assert len(those.at) and all_labels.at.tolist() == those.at.tolist() and all_labels.weight.tolist() == those.weight.tolist()


def test_repeated_rows_and_ids_teach_once(spark, docs):
    rng = random.Random(6)
    rows = [(k, sentences("aa", rng, 40) + (" you idiot" if k % 4 == 0 else "")) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)], "doc_id long, toxic int")
    others = [(4, f"text {n} under the same id") for n in range(500)]
    hashed = docs([rows[4], *others]).selectExpr("text", "xxhash64(text) AS h").collect()
    least = min(hashed, key=lambda r: r.h).text
    plain = toxicity.fit(spark, docs([r for r in rows if r[0] != 4] + [(4, least)]), labels)
    many = toxicity.fit(spark, docs(rows * 3 + others), labels.union(labels))
    assert len(plain.at) and plain.at.tolist() == many.at.tolist() and plain.weight.tolist() == many.weight.tolist()


def test_ftrl_leaves_rare_features_at_zero():
    model = toxicity.FTRL()
    for k in range(400):
        model.learn(np.array([5, 1000 + k]) if k % 2 else np.array([9000 + k]), k % 2)
    assert model.weights(np.array([5]))[0] > 1 and not model.weights(np.arange(1000, 1400)).any()


def test_ftrl_against_a_plain_loop(spark):
    """Every feature of every text on its own, with plain integers, every weight in a dict, one example after the other."""
    import re

    import xxhash
    from math import exp, sqrt

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    order = {r.doc_id: r.o for r in docs.selectExpr("doc_id", "xxhash64(cast(doc_id as string), 17) AS o").collect()}
    text = {r.doc_id: r.text or "" for r in docs.collect()}

    def named(t):
        w = re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]", " ", t.lower()).split(" ")
        w = [x for x in w if x]
        h = [xxhash.xxh64_intdigest(x.encode()) for x in w]
        pairs = [(a * 0x9E3779B97F4A7C15 % 2**64) ^ (b >> 1) for a, b in zip(h, h[1:], strict=False)]
        skips = [(a * 0xC2B2AE3D27D4EB4F % 2**64) ^ (b >> 1) for a, b in zip(h, h[2:], strict=False)]
        return {(x * 0x9E3779B97F4A7C15 % 2**64) >> 64 - toxicity.DIMS_LOG2 for x in h + pairs + skips}

    features = {i: [*sorted(named(t)), "bias"] for i, t in text.items()}
    taught = sorted((order[r.doc_id], r.doc_id, r.toxic) for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1)
    z, n = {}, {}

    def weight(f):
        l1 = 0 if f == "bias" else toxicity.L1
        x = z.get(f, 0.0)
        return 0.0 if abs(x) <= l1 else -(x - (l1 if x > 0 else -l1)) / ((toxicity.BETA + sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    def chance(i):
        return 1 / (1 + exp(-max(-60, min(60, sum(map(weight, features[i]))))))

    for _ in range(toxicity.EPOCHS):
        for _, i, label in taught:
            g = (chance(i) - label) * (toxicity.POSITIVE if label else 1)
            for f, w in [(f, weight(f)) for f in features[i]]:
                before = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (sqrt(before + g * g) - sqrt(before)) / toxicity.ALPHA * w
                n[f] = before + g * g
    out = toxicity.classify_documents(spark, docs, labels).collect()
    assert all(abs(r.score - chance(r.doc_id)) < 1e-6 for r in out) and len({round(r.score, 6) for r in out}) > 20


ITEMS = [(7, "what is the tallest hill of the northern isles? it is the grey stone by the old harbour wall"), (7, "another item of the same id, that asks for something else. the answer has five words too"), (8, "two words"), (9, ""), (10, None), (11, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen")]


def test_leaks(spark, docs):
    rng = random.Random(3)
    noise = lambda n: sentences("aa", rng, n)
    item = ITEMS[0][1]
    rows = ODD + [(100, f"{noise(500)} {item.upper()} {noise(300)}"), (101, noise(400)), (102, item.replace(" ", "\n")), (103, item[:50]), (104, f"{noise(63)} {item}"), (105, "it says two words here"), (106, ITEMS[1][1] + " " + item), (107, " ".join(ITEMS[5][1].split()[:9]))]
    bench = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, score string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark, docs(rows, extra=True), bench).collect()}
    assert got == {(100, 7), (102, 7), (104, 7), (105, 8), (106, 7)}
    clean = decontaminate.clean_documents(spark, docs(rows, extra=True), bench)
    assert clean.columns == docs(rows, extra=True).columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {100, 102, 104, 105, 106} and clean.count() == len(rows) - 5
    assert decontaminate.find_leaks(spark, docs(rows), bench.limit(0)).count() == 0
    assert decontaminate.clean_documents(spark, docs(rows), bench.limit(0)).count() == len(rows)
    assert decontaminate.find_leaks(spark, docs([]), bench).count() == 0


def brute_leaks(docs, items):
    """Every passage against every item: plain BM25 over the item's own score, plain shares of the distinct word runs."""
    from collections import Counter
    from math import log

    bags = [(i, t, Counter(decontaminate.words_of(t))) for i, t in items if decontaminate.words_of(t)]
    n, mean = len(bags), sum(b.total() for *_, b in bags) / max(1, len(bags))
    df = Counter(w for *_, b in bags for w in b)
    part = lambda b, w: log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * b.total() / mean))
    runs = lambda w, k: {tuple(w[s : s + k]) for s in range(max(1, len(w) - k + 1))} if w else set()
    out = set()
    groups = {}
    for i, t, b in bags:
        groups.setdefault(min(k for k, most in enumerate(decontaminate.LENGTHS) if b.total() <= most), []).append((i, t, b))
    for group in groups.values():
        stride = max([64, *(b.total() for *_, b in group)])
        for d, text in docs:
            words = decontaminate.words_of(text)
            for s in range(0, len(words) + 1, stride):
                passage = words[s : s + 2 * stride]
                there = set(passage)
                for i, t, b in group:
                    if sum(part(b, w) for w in b if w in there) / sum(part(b, w) for w in b) < 0.6 - 1e-9:
                        continue
                    shares = []
                    for p in decontaminate.question_and_answer(t):
                        k = min(5, len(p))
                        shares.append(len(runs(p, k) & runs(passage, k)) / len(runs(p, k)) if p else 1.0)
                    if min(shares) >= 0.8:
                        out.add((d, i))
    return sorted(out)


@pytest.mark.parametrize("shard_words, sums", [(1 << 20, 4 << 20), (150, 64)])
def test_leaks_against_brute_force(spark, docs, monkeypatch, shard_words, sums):
    """Whole and partial items, about the thresholds of score and overlap, in one shard and in many."""
    for name, value in (("SHARD_WORDS", shard_words), ("SUMS_AT_ONCE", sums), ("POSTINGS_AT_ONCE", sums)):
        monkeypatch.setattr(decontaminate, name, value)
    rng = random.Random(17)
    vocabulary = [f"w{k}" for k in range(150)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, f"{text(rng.randrange(3, 50))}. {text(rng.randrange(1, 30))}") for k in range(40)] + [(40, text(600)), (41, text(3)), (42, None)]
    rows = []
    for k in range(160):
        words = decontaminate.words_of(rng.choice(items[:41])[1])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = b"other"
        if k % 4 == 0:
            words = words[: int(len(words) * rng.choice([0.5, 0.8, 0.9]))]
        rows.append((k, f"{text(rng.randrange(150))} {b' '.join(words).decode()} {text(rng.randrange(100))}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(rows, items)
    assert len(want) > 60
    assert sorted(map(tuple, decontaminate.find_leaks(spark, docs(rows), bench).select("doc_id", "item_id").collect())) == want
    assert {r.doc_id for r in decontaminate.clean_documents(spark, docs(rows), bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_whole_tables_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = sorted(map(tuple, decontaminate.find_leaks(spark, docs, bench).select("doc_id", "item_id").collect()))
    assert got == brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])


def test_an_index_is_small():
    import pickle

    rng = random.Random(1)
    items = [(k, " ".join(f"w{rng.randrange(30000)}" for _ in range(60))) for k in range(2000)]
    from collections import Counter

    df = Counter(w for _, t in items for w in set(decontaminate.words_of(t)))
    assert len(pickle.dumps(decontaminate.Index(items, dict(df), 2000, 60.0))) < 50 * 120_000


@pytest.mark.parametrize("block", [1, 3, 8])
def test_wand_finds_all_above_the_threshold(monkeypatch, block):
    from collections import Counter

    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(4)
    vocabulary = [f"t{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary[: rng.choice([8, 60])]) for _ in range(rng.randrange(3, 25)))) for k in range(50)]
    df = Counter(t for _, x in items for t in set(decontaminate.words_of(x)))
    index = decontaminate.Index(items, dict(df), 50, 12.0).open()
    for _ in range(150):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randrange(1, 40)))
        score = np.zeros(50)
        for t in terms:
            at = slice(index.at[t], index.at[t + 1])
            score[index.item[at]] += index.impact[at]
        for threshold in (0.1, 0.4, 0.7):
            assert sorted(i for i, _ in index.wand(terms, threshold)) == list(np.flatnonzero(score >= threshold - 1e-9))
