"""The M-tree search against brute force: clusters, ties, many blocks and trees, edge rows."""

import math

import numpy as np
import pytest

from repolens.llm import mtree, queries

from ..conftest import SMALL


def brute(rows, k=10):
    fine = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in fine), default=0)
    fine = [(i, v + [0] * (width - len(v))) for i, v in fine]
    out = []
    for q, w in sorted({(i, tuple(v)) for i, v in fine if i is not None and i % 100 == 0}):
        found = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i is None, i) for i, v in fine if i != q)
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(found[:k])]
    return sorted(out, key=str)


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = mtree.top_k(df, lambda i: i % 100 == 0, **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(i, None if v is None else list(v)) for i, v in [tuple(r) for r in df.collect()]])


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_against_brute_force(spark, monkeypatch, spread):
    for name, value in (("PAGE", 16), ("TREE_ROWS", 200), ("PIVOT_ROWS", 300), ("FANOUT", 4)):
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    v = centres[rng.integers(0, 6, 1500)] + spread * rng.normal(size=(1500, 8))
    v *= rng.uniform(0.2, 2, (1500, 1))
    v[300:700] = v[300]  # copies: ties
    check(spark, [(i, [float(x) for x in r]) for i, r in enumerate(v)], query_block=4)


def test_pruning_happens():
    rng = np.random.default_rng(3)
    x = (1024 * np.repeat(rng.normal(size=(20, 16)), 400, 0) + rng.normal(size=(8000, 16))).astype(np.int64)
    top = float((x * x).sum(1).max())
    tree = mtree.build(np.arange(8000), x, top)
    tree["floats"] = x[tree["ids"]].astype(float)
    visited = []
    plain = mtree.scores_of
    mtree.scores_of = lambda v, *a: visited.append(len(v)) or plain(v, *a)
    try:
        best = mtree.search([tree], x[0], 0, top, [], 10, True)
    finally:
        mtree.scores_of = plain
    assert [-s for s, _ in best] == sorted((x[1:] @ x[0]).tolist(), reverse=True)[:10] and sum(visited) < 2000


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [0.5, -1.0]), (100, [0.5, -1.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, []), (6, [3.0]),
            (None, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (200, [0.0, 0.0])]
    check(spark, rows)
    check(spark, [(0, [3e15, 1.0]), (1, [2e15, 5.0]), (2, [-3e15, 0.0]), (100, [1.0, 1.0])])  # beyond 64 bits
    check(spark, [])
    check(spark, [(0, [1.0])])


def test_query_carries_whole_table(spark):
    out = queries.op4_topk(spark, SMALL)
    assert out.count() == 50 and out.columns == ["query_id", "rank", "vec_id", "score"]
