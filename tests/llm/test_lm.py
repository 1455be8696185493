"""Language model: exact counts and base score, gradients, whole-document state, held-out gain, edge rows."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from repolens.llm import common, gru, lm, queries

from ..conftest import SMALL
from .helpers import edge_docs


def test_base_score_and_held_out_gain(spark):
    folder = SMALL.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in queries.op1_lm_scoring(spark, folder).collect()}
    texts = {r.doc_id: r.text.encode().lower().split() + [None] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    counts = Counter(w for d, t in texts.items() if zlib.crc32(str(d).encode()) % 10 for w in t)
    n, v = sum(counts.values()), len(counts)
    for d, t in texts.items():
        r = rows[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in counts for w in t), n)
        assert abs(r.base_score - sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) < 1e-6 * len(t)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_shared_counts_and_join_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
    whole = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") % 10 == 0).collect()}
    monkeypatch.setattr(lm, "LOCAL_WORDS", 2500)  # more words take the join
    for r in lm.score(docs, F.col("doc_id") % 10 == 0).collect():
        assert r.n_known == whole[r.doc_id].n_known and abs(r.base_score - whole[r.doc_id].base_score) < 1e-6


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    p = gru.started(rng.integers(1, 100, gru.WORDS + 1))
    h = rng.normal(size=(3, gru.HIDDEN)).astype(np.float32)
    for state in h:
        logs = gru.log_probabilities(p, np.repeat(state[None], gru.WORDS + 1, 0), np.arange(gru.WORDS + 1))
        assert abs(np.exp(logs.astype(float)).sum() - 1) < 1e-4


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) + rng.normal(0, 0.1, v.shape) for k, v in gru.started(np.ones(gru.WORDS + 1)).items()}
    docs = [np.append(rng.integers(0, gru.WORDS + 1, n), gru.END).astype(np.int32) for n in (4, 8, 2)]
    inputs, targets, reset, lengths = gru.streams(docs, gru.lanes(docs, 2))
    weight = (np.arange(inputs.shape[1])[None] < lengths[:, None]).T
    at = lambda q: gru.gradients(q, inputs.T, targets.T, reset.T, weight, np.zeros((gru.HIDDEN, 2)))
    g = at(p)[0]
    for k in gru.SHAPES:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        up[k][i] += 1e-4
        down[k][i] -= 1e-4
        assert abs((at(up)[2] - at(down)[2]) / 2e-4 - g[k][i]) < 1e-3 * max(1, abs(g[k][i]))
    assert abs(-gru.score(p, docs).sum() - at(p)[2]) < 1e-3


def test_state_is_carried_over_windows_and_documents_are_apart():
    rng = np.random.default_rng(5)
    p = gru.started(np.ones(gru.WORDS + 1))
    docs = [np.append(rng.integers(0, gru.WORDS + 1, n), gru.END).astype(np.int32) for n in (0, 1, 23, 24, 25, 300, 7)]
    h, alone = None, []
    table = p["embed"] @ p["w"] + p["b"]
    for d in docs:  # one document, one word at a time
        h, total, before = np.zeros((1, gru.HIDDEN)), 0.0, gru.END
        for w in d:
            x, u = table[before][None], h @ p["u"]
            z, r = (gru.sigmoid(x[:, a:a + gru.HIDDEN] + u[:, a:a + gru.HIDDEN]) for a in (0, gru.HIDDEN))
            new = np.tanh(x[:, 2 * gru.HIDDEN:] + r * u[:, 2 * gru.HIDDEN:])
            h, before = new + z * (h - new), w
            total += float(gru.log_probabilities(p, h, np.array([w]))[0])
        alone.append(total)
    assert np.allclose(gru.score(p, docs), alone, rtol=1e-4)


def test_commonest_by_classes(spark):
    rows = [(bytes([97 + i]) * 3, 2**i) for i in range(10)] + [(b"tie%d" % i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "word binary, c long")
    assert common.commonest(df, 100) == sorted(rows, key=lambda x: (-x[1], x[0]))
    assert [c for _, c in common.commonest(df, 4)] == [512, 256, 128, 64]


def test_edge_rows(spark):
    docs = edge_docs(spark)
    out = lm.score(docs, F.col("doc_id") % 5 == 0).collect()
    assert len(out) == docs.count() and all(r.held_out is not None and np.isfinite(r.score) and np.isfinite(r.base_score) for r in out)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[4][0].n_tokens == by[3][0].n_tokens == by[5][0].n_tokens == 1 and abs(by[3][0].score - by[4][0].score) < 1e-6
    none = lm.score(docs, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens) for r in none} == {(0, 0)} and all(np.isfinite(r.score) for r in none)
    assert lm.score(edge_docs(spark, []), F.col("doc_id") % 5 == 0).count() == 0


def test_every_training_document_moves_the_weights(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE_DOCS", 1)  # the start sees hardly any
    words = [b"own%d" % i for i in range(40)]
    train = spark.createDataFrame([(i, w + b" and " + w, False) for i, w in enumerate(words)], "d long, t binary, held_out boolean").repartition(2)
    vocabulary = lm.Vocabulary([(b"and", 40), *((w, 2) for w in words)], 120, 41, 40)
    before, after = gru.started(vocabulary.starts)["embed"], lm.trained(lm.encoded(train, vocabulary).select("d", "ids"), vocabulary)["embed"]
    seen = [vocabulary.number[w] for w in words]  # only a step over a word as an input moves its row
    assert (before[seen] != after[seen]).any(1).all()


def test_training_carries_the_state_through_a_long_document():
    rng = np.random.default_rng(2)
    p = {k: v + rng.normal(0, 1 if k in ("class_w", "word_w") else 0.3, v.shape).astype(np.float32) for k, v in gru.started(np.ones(gru.WORDS + 1)).items()}
    docs = [rng.integers(0, gru.WORDS + 1, n).astype(np.int32) for n in (1030, 7)]
    assert abs(gru.Trainer(p, 0.0).learn(docs) * sum(map(len, docs)) + gru.score(p, docs).sum()) < 0.02


def test_scores_do_not_depend_on_the_files(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART_TOKENS", 20_000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scores = lambda df: {r.doc_id: r.score for r in lm.score(df, F.col("doc_id") % 10 == 0).collect()}
    whole, dealt = scores(docs.coalesce(1)), scores(docs.repartition(7, F.rand(1)))
    assert all(abs(s - dealt[d]) < 1e-6 * abs(s) for d, s in whole.items())


def test_lanes_go_on_across_calls():
    rng = np.random.default_rng(4)
    p = {k: v + rng.normal(0, 1 if k in ("class_w", "word_w") else 0.3, v.shape).astype(np.float32) for k, v in gru.started(np.ones(gru.WORDS + 1)).items()}
    docs = [rng.integers(0, gru.WORDS + 1, n).astype(np.int32) for n in (700, 90, 1, 33, 64, 250, 12, 12, 400)]
    trainer = gru.Trainer(p, 0.0, 3)
    lost = [trainer.feed(docs[a:a + 2])[0] for a in range(0, len(docs), 2)] + [trainer.feed([], True)[0]]
    assert trainer.tokens == sum(map(len, docs)) and trainer.feed([], True) == (0.0, 0)
    assert abs(sum(lost) + gru.score(p, docs).sum()) < 0.05  # each document begins anew and is seen whole


def test_memory_of_scoring_follows_the_tokens():
    import tracemalloc

    p = gru.started(np.ones(gru.WORDS + 1))
    docs = [np.full(n, gru.END, np.int32) for n in (40_000, *[5] * 255)]
    tracemalloc.start()
    total = gru.score(p, docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and np.isfinite(total).all()  # lanes x longest lane is 133 MB
