import collections
import math
import random

import numpy as np
import pytest
from conftest import ODD

from tileflow.llm import components, minhash, vector_links


def closure(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r.node: r.component for r in components.connected_components(spark, spark.createDataFrame(links, "u long, v long")).collect()}
    want = closure(200, links)
    assert got == {k: c for k, c in enumerate(want) if c != k}


def vectors(seed, n=300, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    rows = []
    for k in range(n):
        v = centres[rng.integers(20)] + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.4])
        rows.append((k, [float(x) for x in v], int(rng.integers(3))))
    rows += [(n + k, rows[k][1], rows[k][2]) for k in range(20)]  # equal vectors
    m = n + 20
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0] * 3, [2.0] * 3, [1e-300] * dim, [1e300] * dim]
    rows += [(m + k, v, 1) for k, v in enumerate(odd)] + [(m + 50, rows[0][1], None), (m + 51, rows[0][1], None)]
    return rows


def brute_vectors(rows, threshold=0.93):
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = collections.defaultdict(set)
    for i, a, x in rows:
        for j, b, y in rows:
            if i < j and x == y and usable(a, x) and usable(b, y) and len(a) == len(b) and vector_links.exact_cosine(np.array(a, float), np.array(b, float)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    c = closure(max(i for i, _, _ in rows) + 1, [(i, j) for i in links for j in links[i]])
    return {i: (len(links[i]), c[i], c[i] == i) for i, _, _ in rows}


@pytest.mark.parametrize("root", [0.8, 4, 10**9])
def test_vector_links(spark, monkeypatch, root):
    monkeypatch.setattr(vector_links, "PIVOTS_ROOT", root)
    monkeypatch.setattr(vector_links, "HOME_BLOCK", 16)
    monkeypatch.setattr(vector_links, "MEMBER_BLOCK", 32)
    rows = vectors(4)
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, home string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_links.link_vectors(spark, table).collect()}
    assert got == brute_vectors(rows)


def test_vectors_that_share_an_id_are_one_node(spark):
    a, b, near_b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.1]
    rows = [(1, a, 0), (5, a, 0), (5, b, 0), (7, near_b, 0), (5, None, 0), (9, b, 1)]
    for order in (rows, rows[::-1]):
        got = sorted(tuple(r) for r in vector_links.link_vectors(spark, spark.createDataFrame(order, "vec_id long, embedding array<float>, label int")).collect())
        assert got == sorted([(1, 1, 1, True), (5, 1, 1, False), (5, 1, 1, False), (7, 1, 1, False), (5, 0, 1, False), (9, 0, 9, True)])


def test_clustered_vectors_are_copied_to_few_cells(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    v = vector_links._unit(centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 24)) * 0.1)
    pivots = v[vector_links.farthest_first(v[:500], 16)]
    home, member, _ = vector_links.cells_for(v, pivots, math.sqrt(2 - 2 * 0.93))
    assert len(np.unique(home)) == 16 and member.sum() / len(v) < 5
    rows = spark.createDataFrame([(k, [float(x) for x in row], int(k % 2)) for k, row in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vector_links.link_vectors(spark, rows).collect()}
    for label in (0, 1):
        at = np.arange(label, 4000, 2)
        want = (v[at] @ v[at].T >= 0.93).sum(axis=1) - 1
        assert [got[k] for k in at.tolist()] == want.tolist()


def test_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_links.link_vectors(spark, spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in vector_links.link_vectors(spark, spark.createDataFrame([(1, None, 2)], schema)).collect()] == [(1, 0, 1, True)]


def test_cells_hold_every_partner():
    rng = np.random.default_rng(1)
    v = vector_links._unit(np.concatenate([rng.normal(size=(200, 5)), rng.normal(size=(40, 5)).repeat(5, 0) + rng.normal(size=(200, 5)) * 0.1]))
    eps = math.sqrt(2 - 2 * 0.93)
    home, member, gap = vector_links.cells_for(v, v[:12], eps)
    for i, j in zip(*np.nonzero(v @ v.T >= 0.93), strict=True):
        assert int(member[j, home[i]]) + int(member[i, home[j]]) == (2 if home[i] == home[j] else 1)
        assert abs(gap[i, home[i]] - gap[j, home[i]]) <= eps + 1e-9
    assert member.mean() < 0.5


def brute_sets(rows, size, percent):
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)})
    ids = sorted({i for i, _ in rows if i is not None})
    at = {i: k for k, i in enumerate(ids)}
    links = [(at[rows[i][0]], at[rows[j][0]]) for i in range(len(rows)) for j in range(i) if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    c = closure(len(ids), links)
    return sorted(repr((i, len(s), None if i is None else ids[c[at[i]]], i is None or c[at[i]] == at[i])) for (i, _), s in zip(rows, sets, strict=True))


def copies(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary).upper()
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 5, 8, 40, 90]))]
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed, block", [(1, 256), (2, 3)])
def test_minhash(spark, docs, monkeypatch, seed, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = copies(seed) + [(1000 + (i or 0), t) if i not in (None,) else (i, t) for i, t in ODD]
    got = sorted(repr(tuple(r)) for r in minhash.near_duplicates(spark, docs(rows, extra=True)).collect())
    assert got == brute_sets(rows, 4, 80)


def test_rows_that_share_an_id_and_differ(spark, docs):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(1, a), (1, b), (2, b + " more"), (1, None), (3, a + " more"), (4, ""), (None, b)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        got = sorted(repr(tuple(r)) for r in minhash.near_duplicates(spark, docs(order)).collect())
        assert got == brute_sets(order, 4, 80)


def test_a_chain_whose_leader_links_with_few(spark, docs):
    """Each text is like the next, the first and the last aren't: all is one component all the same."""
    w = [f"u{k}" for k in range(120)]
    rows = []
    for k in range(30):
        rows.append((k, " ".join(w)))
        w[4 * k] = f"v{k}"
    got = sorted(repr(tuple(r)) for r in minhash.near_duplicates(spark, docs(rows)).collect())
    assert got == brute_sets(rows, 4, 80)


def test_steps_drop_little():
    need = minhash.least_matches(80, 1e-6)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 60000, (4000, minhash.MATCHES)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.8, a, a + 1).astype(np.uint16)
    assert minhash.survives(a, b, 80).all()
    b = np.where(rng.random(a.shape) < 0.3, a, a + 1).astype(np.uint16)
    assert not minhash.survives(a, b, 80).any()
    assert list(need) == sorted(need)


def test_no_documents(spark, docs):
    assert minhash.near_duplicates(spark, docs([])).count() == 0
    assert minhash.near_duplicates(spark, docs([(1, None), (2, "")])).count() == 2
    kept = minhash.keep_one(spark, docs(ODD, extra=True))
    assert kept.columns == docs(ODD, extra=True).columns and kept.where("doc_id = 4").count() == 1
