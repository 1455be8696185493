"""Ranked search against a plain evaluation of every pair; the DAG against term-by-term sums."""

import math
import random
import re
from collections import Counter

import numpy as np

from repolens.llm import ranking

from .helpers import edge_docs, edge_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, top=20):
    counts = [(k, terms(t)) for k, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in counts), sum(len(w) for _, w in counts)
    df = Counter(t for _, w in counts for t in set(w))
    out = []
    for item, text in items:
        found = []
        for k, w in counts:
            tf, m = Counter(w), 100 - 25 + 25 * len(w) * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m))
                    for t in terms(text) if tf[t])
            if s > 0:
                found.append((-s, k is None, k or 0))
        out += [(item, r + 1, None if null else k, -s) for r, (s, null, k) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def cases():
    rng = random.Random(11)
    words = ["Ab", "cd", "É", "x1", "zz", "word", "ñ", "日本", "the", "of"] + [f"w{i}" for i in range(60)]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(words) + rng.choice(["", ",", "!"]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(120)]
    docs += [(200 + i, docs[7][1]) for i in range(40)] + [(None, docs[7][1]), (3, docs[3][1]), (300, None), (301, ""), (302, text(5000))]
    common = text(12)
    items = [(i, common + " " + text(rng.choice([0, 1, 4, 9]))) for i in range(12)]
    items += [(20, "zz zz zz the the ab"), (21, ""), (22, None), (23, "unseen"), (None, text(8)), (20, text(6)), (24, docs[7][1])]
    return docs, items + [items[2]]


def test_against_every_pair(spark):
    docs, items = cases()
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sorted((tuple(r) for r in ranking.search(*frames).collect()), key=str) == want
    assert sorted((tuple(r) for r in ranking.search(*frames, block_terms=40).collect()), key=str) == want


def test_plan_shares_sums():
    rng = random.Random(2)
    base = [rng.randrange(400) for _ in range(30)]
    items = [{t: 1 for t in rng.sample(base, 20)} | {rng.randrange(400): rng.choice([1, 1, 3])} for _ in range(50)] + [{}]
    plan = ranking.Plan(items)
    naive = sum(len(x) - 1 for x in items if x)
    assert plan.left and plan.additions < naive / 2
    values = np.array([[rng.randrange(1000) for _ in range(7)] for _ in range(400)])
    held = sorted({t for x in items for t in x})
    doc, term = np.tile(np.arange(7), len(held)), np.repeat(held, 7)
    got = plan.evaluate(doc, term, values[term, doc], 7)
    assert got.tolist() == [[sum(n * values[t, d] for t, n in x.items()) for d in range(7)] for x in items]
    short = ranking.Plan(items, run=8)  # mined in runs of neighbours, the same sums
    assert (short.evaluate(doc, term, values[term, doc], 7) == got).all()


def test_segments(monkeypatch):
    text = ("Ab cd-" * 50 + "x" * 40 + " é" * 30).encode()
    want = ranking.term_counts(text)
    monkeypatch.setattr(ranking, "SEGMENT", 16)
    assert ranking.term_counts(text) == want and want[b"ab"] == 50
    assert not ranking.term_counts(None)


def test_edge_rows(spark):
    docs = edge_docs(spark)
    items = spark.createDataFrame([(1, "the one", 3), (None, "日本語 two"  , 4)], "item_id long, text string, doc_id long")
    want = brute([(r[0], r[1]) for r in edge_rows()], [(1, "the one"), (None, "日本語 two")])
    assert sorted((tuple(r) for r in ranking.search(docs, items).collect()), key=str) == want
    assert ranking.search(edge_docs(spark, []), items).count() == 0
    assert ranking.search(docs, items.where("item_id > 5")).count() == 0
    named = docs.selectExpr("cast(doc_id as string) as name", "text")
    assert ranking.search(named, items, doc_id="name").schema["name"].dataType.simpleString() == "string"
