"""Near-duplicate operators against brute force."""

import random

import numpy as np
import pytest

from millrace.llm import near_dedup
from millrace.llm._base import Scratch
from millrace.llm._graph import components
from millrace.llm.embedding_dedup import near_vectors, quantised


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(400)]
    docs, n = [], 0
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(3, 90))
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((n, ("  " if rng.random() < 0.3 else " ").join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
            n += 1
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, docs[0][1]), (n + 5, docs[0][1])]


def expected(docs):
    sets = {}
    for i, t in docs:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, roots(ids, links)


@pytest.mark.parametrize("long, block", [(64, 512), (2, 3)])
def test_near_dedup(spark, monkeypatch, long, block):
    monkeypatch.setattr(near_dedup, "LONG", long)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    docs = corpus()
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, component_id string, n int")
    got = near_dedup.near_duplicates(rows).collect()
    sets, root = expected(docs)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((i, len(sets[i]), root[i], root[i] == i) for i, _ in docs)
    assert len({r.component_id for r in got}) < len(docs) - 8


def test_near_dedup_keeps_one_of_each_group_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", None), (2, "a b c d e f", "s"), (None, "a b c d e f", "s"), (3, None, "s")], "doc_id long, text string, source string")
    assert sorted((r.doc_id or 0) for r in near_dedup.without_near_duplicates(rows).collect()) == [0, 1, 3]
    assert near_dedup.near_duplicates(rows.limit(0)).count() == 0


def test_recall_of_the_coordinate_filter():
    """Of pairs that are just similar enough, all but a few in 100,000 agree in T coordinates."""
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(400):
        x = rng.integers(0, 2**63, 1750, dtype=np.uint64)
        a, b = near_dedup.signature(x[:1500]), near_dedup.signature(x[250:])  # 1,250 of 1,750 in common: 0.714
        agree.append(int((a == b).sum()))
    assert min(agree) >= near_dedup.T and 43 < np.mean(agree) < 48


def test_a_large_group_of_near_copies_is_joined_by_few_pairs(spark, monkeypatch):
    """Copies with one word changed each: long lists, one component, and no block products."""
    monkeypatch.setattr(near_dedup, "LONG", 8)
    monkeypatch.setattr(near_dedup, "_dense", lambda *a: pytest.fail("compared block by block"))
    base = [f"w{i}" for i in range(300)]
    docs = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(120)]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])


def vectors(n=700, width=16):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, width))
    x = base[rng.integers(0, 60, n)] + rng.normal(scale=0.16, size=(n, width))
    x[5] = x[6] = x[7]
    x[8] = -x[7]
    return x.astype(np.float32)


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr("millrace.llm.embedding_dedup.TILE", 60)
    monkeypatch.setattr("millrace.llm.embedding_dedup.BLOCK", 150)
    x = vectors()
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(2000, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept int")).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    like = u @ u.T >= 0.95
    np.fill_diagonal(like, False)
    assert like.sum() > 1000
    root = roots(range(len(x)), zip(*np.nonzero(like)))
    assert [got[i].n_links for i in range(len(x))] == like.sum(1).tolist()
    assert all(got[i].component_id == root[i] and got[i].kept == (root[i] == i) for i in range(len(x)))
    assert all(got[1000 + i].n_links == 0 and got[1000 + i].component_id == 1000 + i for i in range(6))
    assert got[1006].n_links == got[2000].n_links == 1 and got[2000].component_id == 1006 and got[None].n_links == 0 and got[None].kept


def test_quantisation_bound():
    x = np.random.default_rng(6).normal(size=(50, 33))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, step, error = quantised(x)
    exact, rough = x @ x.T, (q.astype(float) @ q.T.astype(float)) * step[:, None] * step[None, :]
    bound = error[:, None] * (1 + error[None, :]) + error[None, :] * (1 + error[:, None]) + error[:, None] * error[None, :]
    assert (np.abs(exact - rough) <= bound).all() and bound.max() < 0.05


def test_empty_vectors(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
