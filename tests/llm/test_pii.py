"""Personal data: base patterns against the plain regular expressions, the field's inference against brute force."""

import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repolens.llm import pii, queries

from ..conftest import SMALL
from .helpers import edge_docs


def plain(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2]) and \
                (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="aZ09@@..._%+-+ ()1234é\n", max_size=60))
def test_base_spans_equal_the_patterns(t):
    assert [s for s in pii.base_spans(t) if s[0] != "card"] == [s for s in plain(t) if s[0] != "card"]


@pytest.mark.parametrize("t", ["4111 1111 1111 1111", "4111-1111-1111-1112", "x4111111111111111y 256.1.1.1 1.2.3.4.5 a@b.c_d@e.f +1 (415) 555-2671."])
def test_base_examples(t):
    assert sorted(pii.base_spans(t)) == sorted(plain(t))


def test_long_texts_take_linear_time():
    for t in ("a" * 2_000_000 + "@", "1" * 2_000_000, "+" * 2_000_000, "a.b@" * 200_000, "1 " * 1_000_000, "at " * 500_000):
        pii.base_spans(t)
        pii.stretches(t[:200_000])


def test_inference_against_all_segmentations():
    rng = np.random.default_rng(1)
    stretch = pii.stretches("4111 1111 1111 1111 22 333 4444 (415) 555-2671")[0][:9]
    weights = rng.normal(size=(4, pii.N_FEATURES))
    score = pii.scores(stretch, weights)
    sets = [c for n in range(len(stretch) + 1) for c in itertools.combinations(range(len(stretch)), n)
            if all(stretch[a][1] <= stretch[b][0] or stretch[b][1] <= stretch[a][0] for a, b in itertools.combinations(c, 2))]
    total = np.array([sum(score[k] for k in c) for c in sets])
    best = sets[int(total.argmax())]
    assert sorted(pii.best(stretch, weights)) == sorted(stretch[k][:3] for k in best)
    p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
    want = [sum(q for c, q in zip(sets, p) if k in c) for k in range(len(stretch))]
    assert np.allclose(pii.marginals(stretch, weights), want)


@pytest.fixture(scope="module")
def weights(spark):
    docs = spark.read.parquet(f"{SMALL.replace('sf0.001', 'sf0.1')}/documents.parquet")
    return pii.train(pii.sampled(docs))


def test_the_field_adds_spans(weights):
    added = lambda t: [(k, t[a:b]) for k, a, b in pii.method_spans(t, pii.base_spans(t), weights)]
    assert added("call (415) 555-2671 now") == [("phone", "(415) 555-2671")]
    assert added("mail to joe.doe42 [at] example [dot] com today") == [("email", "joe.doe42 [at] example [dot] com")]
    for clean in ("Version 2.0 of 2024-01-01, pages 12 and 13", "look at the end. dot", "Licensed under CC BY-NC 4.0.", "sum 1 2 3 4 5 6"):
        assert added(clean) == []


def test_query_keeps_base_spans(spark):
    out = queries.op9_pii(spark, SMALL.replace("sf0.001", "sf0.01"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL.replace('sf0.001', 'sf0.01')}/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain(docs[r.doc_id])
        spans = set(r.spans.split(",")) if r.spans else set()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= spans and len(spans) == len(base) + r.n_added
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in pii.KINDS]


def test_edge_rows(spark):
    docs = edge_docs(spark)
    out = pii.find(docs).collect()
    assert len(out) == docs.count() and all(r.spans == "" for r in out)
    assert pii.find(edge_docs(spark, [])).count() == 0


def test_long_local_parts_are_not_cut():
    name = "a" * 200
    found = pii.stretches(f"write to {name} [at] example [dot] org now")
    assert [(c[0], c[2]) for s in found for c in s] == [(9, 0)]
