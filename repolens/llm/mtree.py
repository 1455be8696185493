"""Exact top-k search by inner product with M-trees.

Vectors become integers (``floor(SCALE * x)``). One more component,
``sqrt(M * M - |x| ** 2)`` with M the largest norm, turns the largest inner product
into the smallest Euclidean distance, a metric. Vectors are dealt to regions
by their nearest pivot (a bounded sample, ``PIVOTS``; it decides only which
tree a vector is in) and regions of more than ``TREE_ROWS`` into salted
parts, so equal vectors never make one large group. A task builds the M-tree
of a part: leaf pages and inner nodes with a routing object, a covering
radius and the distances to the parent's routing object.

A search takes the query rows in blocks of ``QUERY_BLOCK``, each broadcast
once, against all trees. In a task the trees hang under one root; nodes are
visited best first, children and entries are passed over without computing
their distance when the stored distance to the parent and the triangle
inequality already put them beyond the k-th best, and that bound is carried
from tree to tree. Exact integer scores decide; bounds have slack for rounding, so ties reach the comparison by id.

Vectors that are null or hold null or non-finite components take no part, in
either role. Shorter vectors count as padded with zeros. A row whose id equals the query's
is its own. A null id is no query and the last in ties. Scores beyond 64 bits
are held at the ends of the range. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, saved

SCALE, TOP = 1024, 10
PIVOTS, PIVOT_ROWS = 256, 2048
TREE_ROWS, PAGE, FANOUT = 8192, 256, 16
QUERY_BLOCK = 32_768
LAST = 2**63 - 1


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of long as rows of a matrix, padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, int)
    flat = np.asarray(lists.flatten())
    if len(lists) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lists), width), np.int64)
    at = np.cumsum(lengths) - lengths
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(len(flat)) - np.repeat(at, lengths)] = flat
    return out


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that makes all norms ``sqrt(top)``."""
    x = x.astype(float)
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(-1))


def build(ids: np.ndarray, vectors: np.ndarray, top: float, seed: int = 5) -> dict:
    """An M-tree as arrays: nodes in breadth-first order, each with its children or its range of entries."""
    rng, points = np.random.default_rng(seed), lifted(vectors, top)
    order, queue, nodes = [], [], []

    def node(members, parent):
        centre = points[members].mean(0)
        pivot = members[int(distances(points[members], centre).argmin())]
        d = distances(points[members], points[pivot])
        up = float(distances(points[pivot], points[nodes[parent]["pivot"]])) if parent >= 0 else 0.0
        nodes.append({"pivot": pivot, "radius": float(d.max()), "up": up, "children": None, "entries": None})
        queue.append((len(nodes) - 1, members, d))

    node(np.arange(len(ids)), -1)
    while queue:
        at, members, d = queue.pop(0)
        if len(members) <= PAGE:
            nodes[at]["entries"] = (len(order), len(order) + len(members))
            order += list(zip(members.tolist(), d.tolist()))
            continue
        fan = min(FANOUT, -(-len(members) // PAGE))
        seeds = points[rng.choice(members, fan, replace=False)]
        near = (points[members] @ seeds.T * -2 + (seeds * seeds).sum(1)).argmin(1)
        parts = [members[near == s] for s in range(fan)]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:  # equal vectors
            parts = np.array_split(members, fan)
        nodes[at]["children"] = (len(nodes), len(nodes) + len(parts))
        for p in parts:
            node(p, at)
    chosen = np.array([m for m, _ in order])
    return {"ids": ids[chosen], "vectors": vectors[chosen], "near": np.array([d for _, d in order]),
            "pivots": points[[n["pivot"] for n in nodes]], "radius": np.array([n["radius"] for n in nodes]), "up": np.array([n["up"] for n in nodes]),
            "children": [n["children"] for n in nodes], "entries": [n["entries"] for n in nodes]}


def scores_of(vectors: np.ndarray, floats: np.ndarray, q: np.ndarray, exact: bool) -> list[int]:
    """Integer inner products; by floats where all sums are below 2 ** 53, else by Python's integers."""
    if exact:
        return (floats @ q.astype(float)).astype(np.int64).tolist()
    return [max(-LAST - 1, min(LAST, sum(a * b for a, b in zip(v, q.tolist())))) for v in vectors.tolist()]


def search(trees: list[dict], q: np.ndarray, own: int, top: float, best: list, k: int, exact: bool) -> list:
    """``best`` (negative score, id), sorted, improved by the trees; nodes are taken best first."""
    point, norm = np.append(q.astype(float), 0.0), float((q.astype(float) ** 2).sum())
    slack = 1e-6 * (1 + np.sqrt(norm + top))

    def beyond():
        """Distance beyond which no entry can be among the k best."""
        return np.inf if len(best) < k else np.sqrt(max(norm + top + 2 * best[-1][0], 0)) + slack

    heap = []
    for t, tree in enumerate(trees):
        d = float(distances(tree["pivots"][0], point))
        heapq.heappush(heap, (max(0.0, d - tree["radius"][0]), t, 0, d))
    limit = beyond()
    while heap:
        least, t, at, d = heapq.heappop(heap)
        if least > limit:
            break
        tree = trees[t]
        if tree["children"][at]:
            a, b = tree["children"][at]
            maybe = a + np.flatnonzero(np.abs(d - tree["up"][a:b]) - tree["radius"][a:b] <= limit)
            for c, dc in zip(maybe.tolist(), distances(tree["pivots"][maybe], point).tolist()):
                if (low := max(0.0, dc - tree["radius"][c])) <= limit:
                    heapq.heappush(heap, (low, t, c, dc))
        else:
            a, b = tree["entries"][at]
            maybe = a + np.flatnonzero(np.abs(d - tree["near"][a:b]) <= limit)
            if not len(maybe):
                continue
            near = tree["floats"][maybe] @ point[:-1]
            if len(best) == k:  # scores as floats, with slack, before the exact ones
                maybe = maybe[near >= -best[-1][0] - slack * (1 + abs(best[-1][0])) * 1e-3]
            elif len(maybe) > 4 * k:
                cut = np.partition(near, len(near) - k)[len(near) - k]
                maybe = maybe[near >= cut - slack * (1 + abs(cut)) * 1e-3 - 1] if own not in tree["ids"][maybe] else maybe
            if not len(maybe):
                continue
            found = zip(scores_of(tree["vectors"][maybe], tree["floats"][maybe], q, exact), tree["ids"][maybe].tolist())
            best = heapq.nsmallest(k, [*best, *((-s, i) for s, i in found if i != own)])
            limit = beyond()
    return best


def quantised(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, v): integer vectors of the rows that take part."""
    x = F.transform(vector, lambda c: c.cast("double"))
    rows = df.select(F.col(vec_id).cast("bigint").alias("id"), x.alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("x").isNotNull() & fine).select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def grown(vectors: DataFrame, width: int, top: float, rows: int) -> DataFrame:
    """(tree): pickled M-trees over all vectors."""
    wanted = int(min(PIVOTS, max(1, rows // PIVOT_ROWS)))
    sample = hash_sample(vectors.select("v", F.xxhash64("v").alias("h")).distinct(), "h", wanted).collect()
    pivots = lifted(matrix(pa.array([r.v for r in sample], pa.list_(pa.int64())), width), top)
    half = (pivots * pivots).sum(1) / 2

    def dealt(batches):
        for batch in batches:
            near = (lifted(matrix(batch.column("v"), width), top) @ pivots.T - half).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(near.astype(np.int32))], ["id", "v", "region"])

    regions = saved(vectors.mapInArrow(dealt, "id long, v array<long>, region int"))
    parts = regions.groupBy("region").agg(F.ceil(F.count("*") / TREE_ROWS).alias("parts"))  # at most PIVOTS rows
    placed = regions.join(F.broadcast(parts), "region").withColumn("part", F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.col("parts")))

    def built(batches):
        key, ids, vectors = None, [], []

        def done():
            tree = build(np.concatenate(ids), np.concatenate(vectors), top)
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tree)], pa.binary())], ["tree"])

        for batch in batches:
            v = matrix(batch.column("v"), width)
            i = batch.column("id").fill_null(LAST).to_numpy()
            groups = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("region", "part")], 1)
            cuts = np.flatnonzero(np.concatenate([[True], (groups[1:] != groups[:-1]).any(1)])) if len(groups) else []
            for a, b in zip(cuts, [*cuts[1:], len(groups)]):
                if (g := tuple(groups[a])) != key:
                    if key:
                        yield done()
                    key, ids, vectors = g, [], []
                ids.append(i[a:b])
                vectors.append(v[a:b])
        if key:
            yield done()

    ordered = placed.repartition("region", "part").sortWithinPartitions("region", "part")
    return saved(ordered.select("region", "part", "id", "v").mapInArrow(built, "tree binary"))


def top_k(df: DataFrame, queries, vec_id: str = "vec_id", vector: str = "embedding", k: int = TOP, scale: int = SCALE,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every query; ``queries`` is a condition on the id, as a function of its column."""
    vectors = saved(quantised(df, vec_id, vector, scale))
    n, width, largest, top = vectors.agg(
        F.count("*"), F.max(F.size("v")), F.max(F.expr("aggregate(v, 0D, (m, c) -> greatest(m, abs(cast(c as double))))")),
        F.max(F.expr("aggregate(v, 0D, (m, c) -> m + cast(c as double) * cast(c as double))"))).first()
    spark = df.sparkSession
    schema = "query_id long, qh long, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width)
    exact = width * largest * largest < 2**53
    trees = grown(vectors, width, top, n)
    asked = saved(vectors.where(queries(F.col("id"))).distinct().withColumn("qh", F.xxhash64("v")))
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "qh"), F.lit(blocks)))
    found = []
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).select("id", "qh", "v").toArrow()
        shared = spark.sparkContext.broadcast((rows["id"].to_numpy(), rows["qh"].to_numpy(), matrix(rows["v"], width)))

        def searched(batches, shared=shared):
            ids, hashes, vectors = shared.value
            best: list[list] = [[] for _ in ids]
            for batch in batches:
                for a in range(0, len(batch), 16):
                    group = [pickle.loads(t) for t in batch.column("tree")[a:a + 16].to_pylist()]
                    for t in group:
                        t["floats"] = t["vectors"].astype(float)
                    for q in range(len(ids)):
                        best[q] = search(group, vectors[q], int(ids[q]), top, best[q], k, exact)
            flat = [(int(ids[q]), int(hashes[q]), None if i == LAST else i, -s) for q, rows in enumerate(best) for s, i in rows]
            cols = zip(*flat) if flat else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "qh", "vec_id", "score"])

        found.append(trees.mapInArrow(searched, schema))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    order = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
