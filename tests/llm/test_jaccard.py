"""The PartEnum join against a brute-force version: families of near copies, tiny sets, edge rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from repolens.llm import jaccard

from .helpers import edge_docs


def brute(texts, n, num, den):
    sets = []
    for t in texts:
        w = t.encode().lower().split() if t else []
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter()
        for x in s:
            shared.update(inverted[x])
            inverted[x].append(i)
        for j, k in shared.items():
            if j != i and den * k >= num * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def family(rng, size, copies, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(size)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            k = rng.randrange(len(w))
            w[k:k + rng.choice([0, 1, 1, 2])] = rng.choice([[], [f"e{rng.randrange(10**6)}"], [f"w{rng.randrange(500)}"]])
        yield " ".join(w)


@pytest.mark.parametrize("n,num,blocks", [(4, 85, 1024), (5, 80, 30)])
def test_against_brute_force(spark, monkeypatch, n, num, blocks):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", blocks)
    rng = random.Random(n)
    texts = []
    for size in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 14, 20, 33, 60, 150, 400, 1500):
        texts += family(rng, size, 40, max(1, size // 25 + 1))
    texts += list(family(rng, 120, 300, 9))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sizes, comp = brute(texts, n, num, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, shingle=n, num=num, den=100).collect()}
    assert got == {i: (sizes[i], comp[i]) for i in range(len(texts))}
    assert len(set(comp)) < len(texts) * 0.9
    kept = sorted(r.doc_id for r in jaccard.representatives(docs, shingle=n, num=num, den=100).collect())
    assert kept == sorted(set(comp))


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(2)
    bands, plans = jaccard.Bands(85, 100), {}
    for _ in range(1500):
        size = int(rng.choice([6, 7, 8, 12, 13, 20, 27, 50, 90, 160]))
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        drop, add = rng.integers(0, size // 6 + 1, 2)
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)]))
        if jaccard.linked(len(a), len(b), len(np.setxor1d(a, b)), 85, 100):
            x, y = (set(np.concatenate(jaccard.signatures(s, bands, plans)).tolist()) for s in (a, b))
            assert x & y


def test_edge_rows(spark):
    docs = edge_docs(spark)
    out = jaccard.join(docs, shingle=5, num=80, den=100).collect()
    assert len(out) == docs.count()
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add((r.n_shingles > 0, r.component_id))
    assert by[0] == by[1] == by[2] == {(True, 0)} and by[3] == {(False, 3)} and by[5] == {(False, 5)} and by[6] == {(True, 6)}
    assert by[None] == {(True, 0), (False, None)}  # a null id in the component of 0, and the null text
    kept = jaccard.representatives(docs, shingle=5, num=80, den=100)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[0] == 1 and 1 not in ids and 2 not in ids and ids[3] == 2 and ids[4] == 2 and ids[11] == 1 and ids[None] == 1
    assert jaccard.join(edge_docs(spark, [])).count() == 0 and jaccard.representatives(edge_docs(spark, [])).count() == 0
