import collections
import hashlib
import random

import pytest
from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from tileflow.llm import repeats


def brute(rows, ordered=False):
    words = [(t or "").encode().split() for _, t in rows]
    n = collections.Counter(tuple(w[s : s + 35]) for w in words for s in range(len(w) - 34))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {k for s in range(len(w) - 34) if n[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return list(map(repr, out)) if ordered else sorted(map(repr, out))


def corpus(seed, n=70):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([34, 35, 36, 60, 120]))] for _ in range(6)]
    rows = []
    for k in range(n):
        w = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.random()
            if kind < 0.4:
                w += rng.choice(passages)
            elif kind < 0.5:
                w += ["Is", "onhe."] * rng.randrange(1, 60)
            elif kind < 0.6 and rows:
                w += rng.choice(rows)[1].split(" ")[: rng.randrange(20, 90)]
            else:
                w += [rng.choice(vocabulary) for _ in range(rng.randrange(80))]
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed, batches, max_runs", [(1, 1, 2), (2, 4, 1), (3, 5, 3)])
def test_removed_words(spark, docs, monkeypatch, seed, batches, max_runs):
    monkeypatch.setattr(repeats, "MAX_RUNS", max_runs)
    rows = corpus(seed) + [(1000 + (i or 0) if i is not None else None, t) for i, t in ODD]
    got = sorted(repr(tuple(r)) for r in repeats.remove_repeats(spark, docs(rows, extra=True), batches).collect())
    assert got == brute(rows)


def test_batches_report_what_history_shares(spark):
    entries = lambda *pairs: spark.createDataFrame(pairs, "anchor long, block long")
    index = repeats.FingerprintIndex(spark, max_runs=2)
    got = [sorted(r.anchor for r in index.add(entries(*e)).collect()) for e in ([(1, 1), (2, 1), (2, 2)], [(1, 9), (3, 1)], [(3, 1), (4, 4)], [(5, 5)])]
    assert got == [[2], [1], [3], []]
    assert len(index.runs["entries"]) <= 2
    index.compact("entries", everything=True)
    (run,) = index._tables("entries")
    assert sorted(tuple(r) for r in run.collect()) == [(1, 1, 1), (1, 9, 1), (2, 1, 1), (2, 2, 1), (3, 1, 2), (4, 4, 1), (5, 5, 1)]
    index.close()


@pytest.mark.parametrize("seed, max_runs", [(5, 1), (6, 3)])
def test_calls_on_parts_equal_one_call_on_all(spark, docs, tmp_path, seed, max_runs):
    """Each call opens the index as a later session would; the rows of its documents are those of one call on all so far."""
    rows = corpus(seed, 90) + [(i, t) for i, t in ODD]
    rows[75:75] = rows[3:5] + [(500, rows[7][1]), (500, rows[8][1])]  # the same rows again, and one id for two texts
    path = f"file://{tmp_path}/index"
    for lo, hi in ((0, 0), (0, 40), (40, 70), (70, 71), (71, len(rows))):
        index = repeats.FingerprintIndex.open(spark, path, max_runs, buckets=3)
        out = repeats.remove_repeats(spark, docs(rows[lo:hi], extra=True), 2, index, docs(rows[:lo]))
        got = sorted(repr(tuple(r)) for r in out.collect())
        every = brute(rows[:hi], ordered=True)
        assert got == sorted(every[lo:])
        index.commit()
        index.close()
        assert len(index.runs["entries"]) <= max_runs and len(index.runs["places"]) <= max_runs
    # what isn't committed isn't there
    index = repeats.FingerprintIndex.open(spark, path, max_runs)
    before = index.version, dict(index.runs)
    other = repeats.FingerprintIndex.open(spark, path, 9)
    other.add(spark.createDataFrame([(1, 1)], "anchor long, block long"))
    again = repeats.FingerprintIndex.open(spark, path, max_runs)
    assert (again.version, again.runs) == before and again.buckets == 3
    other.commit()
    with pytest.raises(RuntimeError):
        again.commit()
    with pytest.raises(ValueError):
        repeats.remove_repeats(spark, docs(rows[:2]), 1, again)


def test_history_is_joined_where_it_lies(spark, tmp_path):
    """No exchange and no sort on either side of the join with a historical run, none to merge runs."""
    index = repeats.FingerprintIndex.open(spark, f"file://{tmp_path}/index", 5, buckets=4)
    for k in range(2):
        index.add(spark.range(5000).selectExpr(f"id * {k + 1} AS anchor", "id AS block"))
    run, old = index._tables("entries")
    plan = index.merge_join(run, old)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    merged = index._union("entries").groupBy("anchor", "block").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in merged
    index.close()


def test_long_text_is_cut_into_chunks(monkeypatch):
    words = [b"w%d" % (k * k % 1009) for k in range(900)]
    whole = repeats.Anchors().blocks(words)
    monkeypatch.setattr(repeats, "CHUNK", 100)
    anchor, _, lo, hi = repeats.Anchors().blocks(words)
    assert lo[0] == 0 and hi[-1] == 900 - 35 and (lo[1:] == hi[:-1] + 1).all()
    windows = lambda a, x, y: [int(k) for v, s, e in zip(a, x, y, strict=True) for k in [v] * (e - s + 1)]
    assert windows(anchor, lo, hi) == windows(whole[0], whole[2], whole[3])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=35, max_size=140), st.integers(0, 50))
def test_equal_windows_have_equal_anchors(words, shift):
    """A window's anchor depends on its words alone, wherever it stands."""
    first = repeats.Anchors().blocks(words)
    moved = repeats.Anchors().blocks([b"x%d" % k for k in range(shift)] + words)
    of = lambda blocks: {s: int(a) for a, lo, hi in zip(blocks[0], blocks[2], blocks[3], strict=True) for s in range(lo, hi + 1)}
    a, b = of(first), of(moved)
    assert all(a[s] == b[s + shift] for s in a)


def test_no_documents(spark, docs):
    assert repeats.remove_repeats(spark, docs([])).count() == 0
    assert [tuple(r)[:3] for r in repeats.remove_repeats(spark, docs([(1, None)])).collect()] == [(1, 0, 0)]
