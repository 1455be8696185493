"""Ranked lexical search of many items at once by common-subexpression evaluation.

A document's score for an item is a sum over the item's terms, so items that
share terms share parts of their sums. ``Plan`` mines these parts:

1. terms with the same repeats in the same items are one *class*;
2. the pair of symbols (classes or earlier nodes) that most items hold together
   becomes a new node, again and again, while two items hold one.

The nodes are a DAG. For a batch of documents every class's partial sums are
materialised once, nodes add the sums of their two parts, level by level, and an
item adds the few symbols that are left of it. All sums are 64-bit integers, so
their order can't change a score.

Spark deals the documents: one pass keeps each document's counts of the items'
terms (a row each, in the checkpoint folder) and sums N and L, an aggregate gives
the document frequencies, and a second pass evaluates the DAG over the kept counts.
A task keeps the best rows of every item; those few are ranked by salt, then by item.
Items go in blocks of about ``BLOCK_TERMS`` terms, a block held by the tasks of one
pass, so no size of the item table is assumed.

Null and empty texts have no terms: such documents don't count in N and such items
get no rows. Very long texts are counted in segments. Every row of the item table
is an item of its own, even with an equal or null id; equal scores go by ascending
document id, null last, and repeated documents are ranked each. Empty tables give
an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved
from .hashing import WORD_TABLE

TOP = 20
BLOCK_TERMS = 50_000  # terms of the items that one pass holds
RUN = 64              # symbols of an item among which pairs are mined; longer items are cut into runs of neighbours
CELLS = 4_000_000     # partial sums of a batch of documents
SEGMENT = 1 << 20
SALTS = 32


def term_counts(text: bytes | None) -> Counter:
    """Terms of a text with their occurrences, counted in segments that end at a separator."""
    counts: Counter = Counter()
    at, size = 0, len(text or b"")
    while at < size:
        piece = text[at:at + SEGMENT].translate(WORD_TABLE)
        if at + SEGMENT < size:
            cut = piece.rfind(b" ") + 1
            if not cut:  # a term longer than a segment
                piece = text[at:].translate(WORD_TABLE)
                end = piece.find(b" ")
                piece = piece if end < 0 else piece[:end]
                cut = len(piece)
            piece = piece[:cut]
        counts.update(piece.split())
        at += len(piece)
    return counts


class Plan:
    """The query-sharing DAG of a block of items, given as {term number: repeats} each."""

    def __init__(self, items: list[dict[int, int]], run: int = RUN):
        held = defaultdict(list)
        for i, terms in enumerate(items):
            for t, n in terms.items():
                held[t].append((i, n))
        classes: dict[tuple, list[int]] = {}
        for t, where in held.items():
            classes.setdefault(tuple(where), []).append(t)
        self.classes = len(classes)
        self.terms = np.array([t for terms in classes.values() for t in terms], np.int64)
        self.class_by_term = np.zeros(int(self.terms.max(initial=-1)) + 1, np.int64)
        self.class_by_term[self.terms] = np.repeat(np.arange(self.classes), [len(t) for t in classes.values()])
        #: (symbol, repeats) of every item; only classes that an item holds once are mined.
        self.parts: list[list[tuple[int, int]]] = [[] for _ in items]
        once: list[list[int]] = [[] for _ in items]
        spread = [len(where) for where in classes]
        for c, where in enumerate(classes):
            for i, n in where:
                if n == 1:
                    once[i].append(c)
                else:
                    self.parts[i].append((c, n))
        self.left, self.right = [], []
        pieces = []
        for i, x in enumerate(once):
            x.sort(key=lambda c: (-spread[c], c))
            pieces += [(i, set(x[a:a + run])) for a in range(0, len(x), run)]
        self._mine([p for _, p in pieces])
        for i, p in pieces:
            self.parts[i] += [(s, 1) for s in sorted(p)]
        self._levels()

    def _mine(self, sets: list[set[int]]) -> None:
        """Replace the pair that most sets hold by a node, while two sets hold one."""
        common = Counter(s for x in sets for s in x)
        shared = [np.array(sorted(s for s in x if common[s] > 1), np.int64) for x in sets]
        codes = [(x[a] << 32) + x[b] for x in shared for a, b in [np.triu_indices(len(x), 1)]]
        found, counts = np.unique(np.concatenate(codes or [np.zeros(0, np.int64)]), return_counts=True)
        often = found[counts > 1]
        where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, x in enumerate(codes):
            for code in x[np.isin(x, often)].tolist():
                where[code >> 32, code & 0xFFFFFFFF].add(i)
        heap = [(-len(x), pair) for pair, x in where.items()]
        heapq.heapify(heap)
        while heap:
            count, pair = heapq.heappop(heap)
            now = where.get(pair, ())
            if -count != len(now):
                if len(now) > 1:
                    heapq.heappush(heap, (-len(now), pair))
                continue
            node = self.classes + len(self.left)
            self.left.append(pair[0])
            self.right.append(pair[1])
            fresh: dict[tuple[int, int], set[int]] = defaultdict(set)
            for i in list(now):
                x = sets[i]
                x -= set(pair)
                for s in x:
                    for old in pair:
                        if (known := where.get((min(old, s), max(old, s)))) is not None:
                            known.discard(i)
                    if common[s] > 1:
                        fresh[s, node].add(i)
                x.add(node)
            del where[pair]
            common[node] = -count
            for p, i in fresh.items():
                if len(i) > 1:
                    where[p] = i
                    heapq.heappush(heap, (-len(i), p))

    def _levels(self) -> None:
        depth = [0] * self.classes
        for a, b in zip(self.left, self.right):
            depth.append(1 + max(depth[a], depth[b]))
        deep = np.array(depth, np.int64)
        left, right = np.array(self.left, np.int64), np.array(self.right, np.int64)
        self.levels = []
        for d in range(1, int(deep.max(initial=0)) + 1):
            nodes = np.flatnonzero(deep == d)
            self.levels.append((nodes, left[nodes - self.classes], right[nodes - self.classes]))
        self.sizes = np.array([len(p) for p in self.parts], np.int64)
        self.symbols = np.array([s for p in self.parts for s, _ in p], np.int64)
        self.repeats = np.array([n for p in self.parts for _, n in p], np.int64)
        #: Additions a document takes: classes, nodes and the rest of every item.
        self.additions = len(self.terms) - self.classes + len(self.left) + int(np.maximum(self.sizes - 1, 0).sum())

    @property
    def width(self) -> int:
        return self.classes + len(self.left) + len(self.symbols)

    def evaluate(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """(items, documents) sums of the values (document, term, value) of a batch."""
        sums = np.zeros((self.classes + len(self.left), docs), np.int64)
        np.add.at(sums.reshape(-1), self.class_by_term[term] * docs + doc, value)
        for nodes, left, right in self.levels:
            sums[nodes] = sums[left] + sums[right]
        out = np.zeros((len(self.sizes), docs), np.int64)
        some = np.flatnonzero(self.sizes)
        if len(some):
            begins = (np.cumsum(self.sizes) - self.sizes)[some]
            out[some] = np.add.reduceat(sums[self.symbols] * self.repeats[:, None], begins, axis=0)
        return out


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Best:
    """The best documents of each item so far: by falling score, then ascending id, null last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.kept: list[list[tuple]] = [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, keys: list) -> None:
        order = np.array(sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] if keys[i] is not None else 0)), np.int64)
        item, at = np.nonzero(scores[:, order] >= self.least[:, None])  # documents ascend within an item
        if not len(item):
            return
        found = scores[item, order[at]]
        by = np.lexsort((at, -found, item))
        item, at, found = item[by], at[by], found[by]
        first = np.searchsorted(item, item, "left")
        near = np.arange(len(item)) - first < self.top
        new: dict[int, list[tuple]] = defaultdict(list)
        for i, d, s in zip(item[near].tolist(), order[at[near]].tolist(), found[near].tolist()):
            key = keys[d]
            new[i].append((-s, key is None, key if key is not None else 0))
        for i, rows in new.items():
            self.kept[i] = list(heapq.merge(self.kept[i], rows))[:self.top]
            if len(self.kept[i]) == self.top:
                self.least[i] = -self.kept[i][-1][0]

    def rows(self):
        for i, rows in enumerate(self.kept):
            for s, null, key in rows:
                yield i, None if null else key, -s


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(row, item, terms, times), saved: the distinct terms of every item that has one."""
    kind = items.schema[item].dataType.simpleString()

    def counted(batches):
        for batch in batches:
            counts = [term_counts(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item"), pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                                              pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))], ["row", "item", "terms", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col(item).alias("item"), F.col(text).cast("binary").alias("t"))
    return saved(rows.mapInArrow(counted, f"row long, item {kind}, terms array<binary>, times array<long>").where("size(terms) > 0"))


def _matches(docs: DataFrame, vocabulary) -> DataFrame:
    """(d, n, terms, tfs), saved: every document's length and its counts of the vocabulary, packed as 32-bit integers."""
    kind = docs.schema["d"].dataType.simpleString()

    def matched(batches):
        number = vocabulary.value
        for batch in batches:
            lengths, terms, tfs = [], [], []
            for text in batch.column("t"):
                counts = term_counts(text.as_py())
                hit = counts.keys() & number.keys()
                lengths.append(counts.total())
                terms.append(np.fromiter((number[w] for w in hit), np.int32, len(hit)).tobytes())
                tfs.append(np.fromiter((counts[w] for w in hit), np.int32, len(hit)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())],
                                             ["d", "n", "terms", "tfs"])

    return saved(docs.mapInArrow(matched, f"d {kind}, n long, terms binary, tfs binary"))


def _frequencies(matches: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term; tasks count, Spark sums, at most one row a term comes back."""
    def counted(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                df[np.frombuffer(t, np.int32)] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["term", "df"])

    found = np.zeros(size, np.int64)
    for r in matches.select("terms").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        found[r.term] = r.df
    return found


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents with a score above 0 of every row of ``items``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("binary").alias("t"))
    rows = item_terms(items, item_id, item_text)
    held = rows.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-held // block_terms))
    kind = docs.schema["d"].dataType.simpleString()
    best, totals = [], None
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "terms", "times").collect()
        number: dict[bytes, int] = {}
        wanted = [{number.setdefault(bytes(t), len(number)): n for t, n in zip(r.terms, r.times)} for r in block]
        shared = spark.sparkContext.broadcast(number)
        matches = _matches(docs, shared)
        if totals is None:
            totals = matches.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        model = spark.sparkContext.broadcast((Plan(wanted), weights(_frequencies(matches, len(number)), totals[0]), [r.row for r in block]))
        best.append(_best(matches, model, tuple(totals), kind, top))
        shared.unpersist()
    found = reduce(DataFrame.unionByName, best)
    by = [F.col("score").desc(), F.col("d").asc_nulls_last()]
    rank = F.row_number()
    found = found.withColumn("r", rank.over(Window.partitionBy("row", "salt").orderBy(*by))).where(F.col("r") <= top)
    found = found.withColumn("rank", rank.over(Window.partitionBy("row").orderBy(*by))).where(F.col("rank") <= top)
    return found.join(rows.select("row", "item"), "row").select(
        F.col("item").alias(item_id), "rank", F.col("d").alias(doc_id), "score")


def _best(matches: DataFrame, model, totals: tuple[int, int], kind: str, top: int) -> DataFrame:
    """(row, d, score, salt): the best documents of every item among those of each task."""
    n_docs, n_terms = totals

    def scored(batches):
        plan, weight, rows = model.value
        best = Best(len(rows), top)
        most = max(1, CELLS // max(1, plan.width))
        for batch in batches:
            for a in range(0, len(batch), most):
                part = batch.slice(a, most)
                found = [np.frombuffer(t, np.int32) for t in part.column("terms").to_pylist()]
                doc = np.repeat(np.arange(len(found)), [len(t) for t in found])
                if not len(doc):
                    continue
                term = np.concatenate(found).astype(np.int64)
                tf = np.concatenate([np.frombuffer(t, np.int32) for t in part.column("tfs").to_pylist()]).astype(np.int64)
                m = np.array([75 + 25 * n * n_docs // max(1, n_terms) for n in part.column("n").to_pylist()], np.int64)
                value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
                best.add(plan.evaluate(doc, term, value, len(found)), part.column("d").to_pylist())
        out = list(best.rows())
        salt = TaskContext.get().partitionId() % SALTS
        for a in range(0, len(out), 10_000):
            i, d, s = zip(*out[a:a + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array([rows[x] for x in i], pa.int64()), pa.array(d, key_kind(kind)), pa.array(s, pa.int64()),
                                              pa.array([salt] * len(i), pa.int32())], ["row", "d", "score", "salt"])

    return matches.mapInArrow(scored, f"row long, d {kind}, score long, salt int")


def key_kind(kind: str) -> pa.DataType:
    """The Arrow type of an id column: integers or strings."""
    return {"string": pa.string(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.int64())
