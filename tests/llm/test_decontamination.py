"""Decontamination against a brute-force version, in one block and in several."""

import hashlib
import random
import re

from repolens.llm import decontamination

from .helpers import edge_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench):
    known = {}
    for item, text in bench:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            known.setdefault(tuple(w[i:i + n]), set()).add("null" if item is None else str(item))
    lengths = {len(k) for k in known}
    out = []
    for d, text in docs:
        w, hit, items = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (g := known.get(tuple(w[i:i + n]))):
                    hit |= set(range(i, i + n))
                    items |= g
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(8)
    vocab = ["ab", "cd", "É", "x1", "zz", "word", "ñ"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocab) + rng.choice(["", ",", "!"]) for _ in range(n))
    bench = [(i, text(rng.choice([1, 3, 5, 9, 10, 11, 30]))) for i in range(1, 40)] + [(40, ""), (41, None), (42, "!!"), (None, text(12)), (7, text(20))]
    bench.append(bench[5])
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    docs += [(100 + i, f"{text(9)} {b[1] or ''} {text(5)}") for i, b in enumerate(bench)] + [(200, None), (200, ""), (3, docs[3][1])]
    long = text(40000)
    return docs + [(300, long + " " + bench[20][1])], bench


def test_against_brute_force(spark):
    docs, bench = cases()
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    assert sorted((tuple(r) for r in decontamination.report(*frames).collect()), key=str) == want
    assert sorted((tuple(r) for r in decontamination.report(*frames, block_rows=100).collect()), key=str) == want


def test_edge_rows(spark):
    docs = edge_docs(spark)
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    out = decontamination.flagged(docs, bench, added="hit")
    assert "hit_input" in out.columns and out.count() == docs.count()
    assert [r.doc_id for r in out.where("size(hit.hits) > 0").collect()] == [13]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.report(docs, none).where("contaminated").count() == 0
    assert decontamination.report(edge_docs(spark, []), bench).count() == 0
