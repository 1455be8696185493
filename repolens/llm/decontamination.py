"""Benchmark decontamination by winnowing.

A fingerprint is the smallest hash among ``SPAN - K + 1`` neighbouring k-grams.
Every run of ``SPAN`` words has exactly one, and equal runs have equal ones, so
each shared span of ``SPAN`` words shares a fingerprint. Fingerprints of the
documents are joined with those of the benchmark; where they meet, the hit is
extended to the whole window of words and compared word by word, so results
are exact. Items shorter than ``SPAN`` words are one window, found by their own
n-gram hash (winnowing with a window of one k-gram).

The benchmark's windows are distinct rows in blocks of at most ``BLOCK_ROWS``;
a block is held by the tasks of one pass over the documents, which need no
shuffle. With more than one block each gets a pass and their hits are merged by document.

Null and empty texts have no words and no hits; very long texts are hashed in
segments; repeated documents get a row each, repeated items count once; items
without words are left out; an empty table gives an empty result, an empty
benchmark no hits. Further columns are kept by ``flagged`` (one named like the
added one as ``<name>_input``) and ignored by ``report``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import hashing
from .common import positional, restored, saved

SPAN, K = 10, 5
BLOCK_ROWS = 200_000
RESULT = "struct<n_words: bigint, hits: array<int>, items: array<string>>"


def windows(bench: DataFrame, item: str = "item_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """Distinct (item, window): all runs of ``span`` words of an item, or all its words if they are fewer."""

    @arrow_udf("array<binary>")
    def runs(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            w = t.translate(hashing.WORD_TABLE).split() if t else []
            n = min(span, len(w))
            out.append([b" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] if w else [])
        return pa.array(out, pa.list_(pa.binary()))

    return bench.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"),
                        F.explode(runs(F.col(text).cast("binary"))).alias("window")).distinct()


class Index:
    """The windows of one block: per length their sorted hashes and words, and the winnowed fingerprints."""

    def __init__(self, rows: list[tuple[str, bytes]], span: int = SPAN, k: int = K):
        self.span, self.k = span, k
        self.items: dict[bytes, list[str]] = {}
        for item, window in rows:
            self.items.setdefault(bytes(window), []).append(item)
        by_length: dict[int, list[int]] = {}
        fingerprints = []
        for window in self.items:
            h = hashing.words(window)[2]
            by_length.setdefault(len(h), []).append(int(hashing.ngrams(h, len(h))[0]))
            if len(h) == span:
                fingerprints.append(int(hashing.ngrams(h, k).min()))
        self.hashes = {n: np.unique(np.array(x, np.uint64)) for n, x in by_length.items()}
        self.fingerprints = np.unique(np.array(fingerprints, np.uint64))

    def candidates(self, h: np.ndarray):
        """(length, places) where the words may begin a window of the block."""
        for n, known in self.hashes.items():
            if len(h) < n:
                continue
            if n < self.span:
                places = np.flatnonzero(member(hashing.ngrams(h, n), known))
            else:
                places = self.winnowed(h)
                if len(places):
                    run = np.zeros(len(places), np.uint64)
                    for j in range(n):
                        run = run * hashing._PLACE + h[places + j]
                    places = places[member(hashing.mix(run + np.uint64(n)), known)]
            if len(places):
                yield n, places

    def winnowed(self, h: np.ndarray) -> np.ndarray:
        """Places of the runs of ``span`` words whose fingerprint the benchmark has."""
        grams = hashing.ngrams(h, self.k)
        count = len(h) - self.span + 1
        least = grams[:count].copy()
        for j in range(1, self.span - self.k + 1):
            np.minimum(least, grams[j:j + count], out=least)
        change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))  # neighbours share fingerprints
        known = member(least[change], self.fingerprints)
        if not known.any():
            return np.zeros(0, np.int64)
        return np.flatnonzero(np.repeat(known, np.diff(np.append(change, count))))

    def scan(self, texts: list[bytes | None]) -> list[dict]:
        """Of each text its number of words, the places of its hit words and the items whose windows occur."""
        out = []
        for a, b in hashing.chunks(texts):
            data, starts, ends, h, first = hashing.joined(texts[a:b], hashing.WORD_TABLE)
            found: dict[int, tuple[list, set]] = {}
            for n, places in self.candidates(h):
                text_of = np.searchsorted(first, places, "right") - 1
                inside = places + n <= first[text_of + 1]  # not across two texts
                for p, d in zip(places[inside].tolist(), text_of[inside].tolist()):
                    window = b" ".join(data[starts[p + j]:ends[p + j]] for j in range(n))
                    if window in self.items:
                        runs, hit = found.setdefault(d, ([], set()))
                        runs.append((p - int(first[d]), n))
                        hit.add(window)
            sizes = np.diff(first)
            for d in range(b - a):
                row = {"n_words": int(sizes[d]), "hits": [], "items": []}
                if d in found:
                    on = np.zeros(row["n_words"] + 1, np.int64)
                    for p, n in found[d][0]:
                        on[p] += 1
                        on[p + n] -= 1
                    row["hits"] = np.flatnonzero(np.cumsum(on) > 0).tolist()
                    row["items"] = sorted({i for w in found[d][1] for i in self.items[w]})
                out.append(row)
        return out


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def scan_column(text: Column, shared, span: int = SPAN) -> Column:
    """The hits of a text column with one block of windows, a broadcast list of (item, window)."""
    cache: dict[str, Index] = {}

    @arrow_udf(RESULT)
    def scanned(texts: pa.Array) -> pa.Array:
        if "index" not in cache:
            cache["index"] = Index(shared.value, span)
        kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
        return pa.array(cache["index"].scan(texts.to_pylist()), kind)

    return scanned(text.cast("binary"))


def flagged(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
            span: int = SPAN, block_rows: int = BLOCK_ROWS, added: str = "hit") -> DataFrame:
    """``docs`` with a struct column ``added`` of n_words, hits (places of hit words) and items (strings, sorted).

    One block is held by the tasks of the one pass. With more, each block gets a pass that keeps the
    hits of distinct texts in the checkpoint folder, and the last pass joins them by the text's digest.
    """
    docs, names = positional(docs)
    text = names[text]
    share = docs.sparkSession.sparkContext.broadcast
    rows = saved(windows(bench, item, item_text, span))
    n = max(1, -(-rows.count() // block_rows))
    if n == 1:
        return restored(docs.withColumn(added, scan_column(F.col(text), share([tuple(r) for r in rows.collect()]), span)), names, added)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item", "window"), F.lit(n)))
    parts = []
    for i in range(n):
        block = share([tuple(r) for r in rows.where(F.col("block") == i).select("item", "window").collect()])
        hit = docs.select(F.md5(text).alias("digest"), scan_column(F.col(text), block, span).alias("h")).where("size(h.hits) > 0")
        parts.append(saved(hit.dropDuplicates(["digest"])))
        block.destroy()
    merged = reduce(DataFrame.unionByName, parts).groupBy("digest").agg(
        F.array_distinct(F.flatten(F.collect_list("h.hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("h.items")))).alias("items"))  # at most n rows of a digest
    wide = docs.withColumn("h", scan_column(F.col(text), share([]), span)).withColumn("d", F.md5(text))
    joined = wide.join(merged, F.col("d") == F.col("digest"), "left")
    return restored(joined.withColumn(added, F.struct(
        F.col("h.n_words").alias("n_words"), F.coalesce("hits", "h.hits").alias("hits"), F.coalesce("items", "h.items").alias("items"))), names, added)


def report(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each document."""
    hit = flagged(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")), bench, "t", added="hit", **options)
    return hit.select(
        F.col("d").alias(doc_id), F.col("hit.n_words").alias("n_words"), F.size("hit.hits").cast("bigint").alias("n_hit"),
        F.size("hit.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit.items"), 256).alias("items_sha256"), (F.size("hit.hits") > 0).alias("contaminated"))
