"""Scores of whole documents under a gated recurrent language model learnt from the table.

1. Words of all training documents are counted (tasks count, Spark sums).
2. Every document is encoded once, as 16-bit numbers of the model's words, into the checkpoint folder.
3. The model (``gru``) starts on one bounded sample of ``SAMPLE_DOCS`` training
   documents, ended after ``SAMPLE_TOKENS`` tokens. Then all training documents are dealt by a hash of
   id and words to parts of about ``PART_TOKENS`` tokens, whatever the table's files. Every part
   goes on from there over all its documents, state carried through each, lanes kept full from document to document,
   and the weights are averaged, by tokens.
4. Every document is scored whole, state carried through all its windows. Words
   beyond the model's own have the probability of their class times their
   share of it by counts, ``(c + 0.1) / Z``, so probabilities of all words sum to one.

Counts of the ``LOCAL_WORDS`` commonest words are shared with the tasks; the
other words of a document go, once each, through a join with the full table of
counts, which holds no hot word. What grows with the corpus stays in Spark.

Null and empty texts are the end mark alone; very long texts are scored whole; equal
texts get equal scores; repeated rows get a row each; a null id is a training
document. An empty table gives an empty result; without training rows all
counts are 0. Further columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import ascii_words, commonest, hash_sample, saved, word_counts

ADDED = 0.1
LOCAL_WORDS = 200_000
SAMPLE_DOCS, SAMPLE_TOKENS, EPOCHS, RATE = 1500, 500_000, 3, 0.01
PASS_RATE, PASS_LANES, PART_TOKENS = 0.004, 256, 4_000_000
GROUP, GROUP_TOKENS = 2000, 1_000_000  # documents and tokens that a task feeds or scores at a time
CHUNKS = 64
ENCODED = "n_tokens long, n_known long, base double, far double, ids binary, words array<binary>, times array<int>"


class Vocabulary:
    """The commonest words with their counts, and the sums over all words."""

    def __init__(self, top: list[tuple[bytes, int]], tokens: int, types: int, ends: int):
        self.number = {w: i for i, (w, _) in enumerate(top)}
        self.counts = np.array([c for _, c in top], np.int64)
        self.ends, self.tokens, self.types = ends, tokens + ends, types + (ends > 0)
        own = self.counts[:gru.END]
        self.other = self.tokens - int(own.sum()) - ends + ADDED * (self.types - len(own) - (ends > 0)) + ADDED
        self.whole = self.tokens + ADDED * (self.types + 1)
        self.starts = np.zeros(gru.WORDS + 1)
        self.starts[:len(own)], self.starts[gru.END], self.starts[gru.OTHER] = own, ends, max(0, self.tokens - own.sum() - ends)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Places among the commonest words, -1 for others."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The model's numbers, with the end mark."""
        ids = np.full(len(numbers) + 1, gru.END, np.int32)
        ids[:-1] = np.where((numbers >= 0) & (numbers < gru.END), numbers, gru.OTHER)
        return ids


def groups(ids: list[bytes]):
    """Encoded documents in groups of bounded numbers of documents and tokens (a longer document alone)."""
    held, size = [], 0
    for x in ids:
        if held and (len(held) >= GROUP or size + len(x) > 2 * GROUP_TOKENS):
            yield held
            held, size = [], 0
        held.append(np.frombuffer(x, np.int16).astype(np.int32))
        size += len(x)
    if held:
        yield held


def encoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(row, d, held_out, ENCODED), saved: counts, base score and model numbers of every text ``t``; words that the tasks don't know."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    known_end = int(vocabulary.ends > 0)

    def coded(batches):
        v = shared.value
        base_end = np.log10((v.ends + ADDED) / v.whole)
        log_count = np.log10(v.counts + ADDED) if len(v.counts) else np.zeros(1)
        log_whole, log_other = np.log10(v.whole), np.log10(v.other)
        for batch in batches:
            ids, sums, rest = [], [], []
            for text in batch.column("t"):
                words = ascii_words(text.as_py())
                at = v.numbers(words)
                ids.append(v.ids(at).astype(np.int16).tobytes())
                here = at[at >= 0]
                far = here[here >= gru.END]
                sums.append((len(words) + 1, len(here) + known_end, log_count[here].sum() - len(here) * log_whole + base_end,
                             log_count[far].sum() - len(far) * log_other))
                missing = {}
                if len(here) < len(words):
                    for i in np.flatnonzero(at < 0).tolist():
                        missing[words[i]] = missing.get(words[i], 0) + 1
                rest.append(missing)
            n, known, base, far = zip(*sums) if sums else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column("d"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                pa.array(far, pa.float64()), pa.array(ids, pa.binary()), pa.array([list(m) for m in rest], pa.list_(pa.binary())),
                pa.array([list(m.values()) for m in rest], pa.list_(pa.int32()))],
                ["d", "held_out", "n_tokens", "n_known", "base", "far", "ids", "words", "times"])

    kind = rows.schema["d"].dataType.simpleString()
    return saved(rows.mapInArrow(coded, f"d {kind}, held_out boolean, {ENCODED}").withColumn("row", F.monotonically_increasing_id()))


def trained(train: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Weights from encoded documents (d, ids): a start on the bounded sample, then the mean of every part's own steps."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary.starts)

    def first(batches):
        documents, tokens = [], 0
        for batch in batches:
            for x in batch.column("ids").to_pylist():
                if tokens < SAMPLE_TOKENS:
                    documents.append(np.frombuffer(x, np.int16).astype(np.int32))
                    tokens += len(documents[-1])
        trainer = gru.Trainer(gru.started(shared.value), RATE)
        for _ in range(EPOCHS):
            trainer.learn(documents)
            trainer.rate /= 2
        yield pa.RecordBatch.from_arrays([pa.array([trainer.flat.tobytes()], pa.binary())], ["weights"])

    train = train.withColumn("h", F.xxhash64("d", "ids"))
    rows = hash_sample(train, "h", SAMPLE_DOCS).coalesce(1).mapInArrow(first, "weights binary").collect()
    start = np.frombuffer(rows[0].weights, np.float32) if rows else gru.packed(gru.started(vocabulary.starts))
    begin = spark.sparkContext.broadcast(start)

    def more(batches):
        trainer = gru.Trainer(gru.unpacked(begin.value.copy()), PASS_RATE, PASS_LANES)
        for batch in batches:
            for documents in groups(batch.column("ids").to_pylist()):
                trainer.feed(documents)
        trainer.feed([], True)
        if trainer.tokens:
            for i, part in enumerate(np.array_split(trainer.flat.astype(float) * trainer.tokens, CHUNKS)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([trainer.tokens], pa.int64()), pa.array([part.tobytes()], pa.binary())],
                                                 ["chunk", "tokens", "part"])

    def summed(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for i, n, part in zip(*(c.to_pylist() for c in batch.columns)):
                at = sums.setdefault(i, [0, 0.0])
                at[0] += n
                at[1] = at[1] + np.frombuffer(part)
        for i, (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([(total / n).tobytes()], pa.binary())], ["chunk", "mean"])

    dealt = train.repartition(max(1, -(-vocabulary.tokens // PART_TOKENS)), "h").sortWithinPartitions("h")
    means = dealt.select("ids").mapInArrow(more, "chunk int, tokens long, part binary").repartition("chunk").mapInArrow(summed, "chunk int, mean binary")
    parts = {r.chunk: np.frombuffer(r.mean) for r in means.collect()}  # CHUNKS rows of a fixed size
    return gru.unpacked(np.concatenate([parts[i] for i in range(CHUNKS)]) if parts else start)


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("d"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("binary").alias("t"))
    train = rows.where(~F.col("held_out"))
    counts = saved(word_counts(train.select("t")))
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = commonest(counts, LOCAL_WORDS)
    vocabulary = Vocabulary(top, tokens, types, train.count())
    parts = encoded(rows, vocabulary)
    weights = trained(parts.where(~F.col("held_out")).select("d", "ids"), vocabulary)
    model = spark.sparkContext.broadcast(gru.packed(weights))

    def scored(batches):
        p = gru.unpacked(model.value)
        for batch in batches:
            sums = [gru.score(p, documents) for documents in groups(batch.column("ids").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(sums) / np.log(10) if sums else [], pa.float64())],
                                             ["row", "log"])

    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
    found = rare.join(counts.where(F.lit(True)).withColumnRenamed("word", "words"), "words", "left")
    c = F.coalesce("c", F.lit(0))
    sums = found.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("k"),
        F.sum(F.log10((c + ADDED) / F.lit(float(vocabulary.whole))) * F.col("times")).alias("b"),
        F.sum(F.log10((c + ADDED) / F.lit(float(vocabulary.other))) * F.col("times")).alias("s"))
    zero = F.lit(0)
    by_model = parts.select("row", "ids").mapInArrow(scored, "row long, log double")
    return parts.drop("words", "times", "ids").join(by_model, "row").join(sums, "row", "left").select(
        F.col("d").alias(doc_id), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", zero)).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("log") + F.col("far") + F.coalesce("s", zero)).alias("score"))
