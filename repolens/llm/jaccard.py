"""Similarity join on word shingles by PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct n-word shingles; equal
sets are one node. Two sets link when ``den * intersection >= num * union``.

Signatures. Sets are joined in size bands: key j serves pairs whose smaller set
lies in band j, and such pairs differ in at most ``k`` shingles. PartEnum
splits the shingle domain into ``n1`` first-level partitions of ``n2`` cells
each, with ``n1 * (k2 + 1) > k``: some partition of a linked pair has at most
``k2`` differing cells, so the pair shares a signature among the subsets of
``n2 - k2`` cells of it. Signatures of empty subsets are left out; a set that has more of them than
spare agreements goes on to another split of the domain (``SPLITS`` in all; the last keeps the empty ones), so no linked pair is lost.

Verification. Signatures are shuffled once and sorted; the smallest node of a
signature leads it. Members that share a leader meet in groups split into
pairs of blocks of bounded size. A member is held as its symmetric difference from the
leader, which is small for near copies, and exact intersections follow from
counts over an inverted list of those differences. Members linked to the leader form one
component at once, so only the others are compared with all; links that join nothing new are
not written. Components come from label propagation with pointer jumping over those links.

Null and empty texts (and texts of white space) have the empty set, size 0,
and link with nothing; texts of fewer words than a shingle are one shingle;
repeated rows get a row each, a repeated id reports the smallest id of its
component; a null id stays null and is never the smallest. An empty table
gives an empty result. Further columns are kept by ``representatives``, ignored otherwise.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import hashing
from .common import positional, restored, saved

SHINGLE, NUM, DEN = 5, 80, 100
SPLITS = 10
CELLS = 2  # cells of a partition, one of which may differ
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 4_000_000
BROADCAST_IDS = 1_000_000


def sets(texts: list[bytes | None], n: int):
    """The sorted distinct shingle hashes of each text, in order."""
    for a, b in hashing.chunks(texts):
        _, _, _, h, first = hashing.joined(texts[a:b], hashing.BLANK_TABLE)
        grams = hashing.ngrams(h, n)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo >= n:
                yield np.unique(grams[lo:hi - n + 1])
            else:
                yield hashing.ngrams(h[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64)


def node_of(shingles: np.ndarray) -> int | None:
    """The identity of a set: 64 bits of its hashes (None: the empty set)."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63 if len(shingles) else None


def node_column(text: str, n: int) -> Column:
    """The node of a text column."""
    @arrow_udf("long")
    def node(texts: pa.Array) -> pa.Array:
        return pa.array([node_of(s) for s in sets(texts.to_pylist(), n)], pa.int64())

    return node(F.col(text).cast("binary"))


class Bands:
    """Size bands and the PartEnum parameters of each key."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.starts = num, den, [1]

    def upto(self, size: int) -> None:
        while self.starts[-1] <= size * self.den // self.num + 1 or len(self.starts) < 3:
            last = self.starts[-1]
            self.starts.append(last * self.den // self.num + 1)

    def keys(self, size: int) -> list[int]:
        """The keys that a set takes part in: its own band, and the one below if a set there can be similar."""
        self.upto(size)
        j = int(np.searchsorted(self.starts, size, "right")) - 1
        return [j, j - 1] if j and (self.starts[j] - 1) * self.den // self.num >= size else [j]

    def plan(self, j: int) -> tuple[int, int, int, int]:
        """(n1, n2, k2, spare): partitions, cells of each, differing cells borne, agreeing signatures beyond one."""
        self.upto(self.starts[j] if j < len(self.starts) else 1)
        while len(self.starts) <= j + 1:
            self.upto(self.starts[-1] * 2)
        k = (self.den - self.num) * (self.starts[j + 1] - 1) // self.num
        if k == 0:
            return 1, 1, 0, 0
        if k == 1:
            return 1, 4, 1, 0
        first, typical = (k + 2) // 2, math.sqrt(self.starts[j] * self.starts[j + 1])

        def cost(n1: int) -> float:
            """Expected signatures of a set of typical size: splits go on when more are empty than spare."""
            spare, empty = CELLS * n1 - (CELLS - 1) * k - 1, CELLS * n1 * math.exp(-typical * (CELLS - 1) / (CELLS * n1))
            within = sum(math.exp(i * math.log(empty) - empty - math.lgamma(i + 1)) for i in range(int(spare) + 1))
            return CELLS * n1 / max(within, 1e-3)

        n1 = min(range(first, 2 * first + 1), key=cost)
        return n1, CELLS, 1, CELLS * n1 - (CELLS - 1) * k - 1


def signatures(shingles: np.ndarray, bands: Bands, plans: dict) -> list[np.ndarray]:
    out = []
    for j in bands.keys(len(shingles)):
        if j not in plans:
            plans[j] = bands.plan(j)
        n1, n2, k2, spare = plans[j]
        cells = n1 * n2
        for split in range(SPLITS):
            mixed = hashing.mix(shingles ^ np.uint64((0x51A7 + split) * 0x9E3779B97F4A7C15 % 2**64))
            cell = ((mixed >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(cells, np.uint64)
            np.add.at(sums, cell, hashing.mix(mixed))
            full = np.bincount(cell, minlength=cells) > 0
            subsets = list(combinations(range(n2), n2 - k2))
            by_part, full = sums.reshape(n1, n2), full.reshape(n1, n2)
            signed = np.stack([by_part[:, s].sum(1, dtype=np.uint64) for s in map(list, subsets)], 1)
            there = np.stack([full[:, s].any(1) for s in map(list, subsets)], 1)
            place = np.arange(signed.size, dtype=np.uint64).reshape(signed.shape) + np.uint64((j * SPLITS + split) << 32)
            signed = hashing.mix(signed + hashing.mix(place))
            last = split == SPLITS - 1
            out.append(signed.ravel() if last else signed[there])
            if there.size - there.sum() <= spare:
                break
    return out


def described(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(doc_id, n_shingles, node) of every row."""
    @arrow_udf("struct<n: bigint, node: bigint>")
    def one(texts: pa.Array) -> pa.Array:
        rows = [(len(s), node_of(s)) for s in sets(texts.to_pylist(), n)]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["n", "node"])

    return docs.select(F.col(doc_id).alias("doc_id"), one(F.col(text).cast("binary")).alias("s")).select(
        "doc_id", F.col("s.n").alias("n_shingles"), F.col("s.node").alias("node"))


def led(docs: DataFrame, text: str, n: int, num: int, den: int) -> DataFrame:
    """Distinct (leader, node): nodes that share a signature with the smallest node of it."""

    def signed(batches):
        bands, plans = Bands(num, den), {}
        for batch in batches:
            seen, sig, node = set(), [], []
            for s in sets(batch.column(0).to_pylist(), n):
                if len(s) and (x := node_of(s)) not in seen:  # equal sets of a batch sign once
                    seen.add(x)
                    found = signatures(s, bands, plans)
                    sig += found
                    node += [np.full(len(f), x, np.int64) for f in found]
                if sum(map(len, sig[-1:])) and len(sig) > 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(node))], ["sig", "node"])
                    sig, node = [], []
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(node))], ["sig", "node"])

    def leaders(batches):
        """Streams sorted rows; of a signature it holds the first node only."""
        last_sig, leader = None, None
        for batch in batches:
            sig, node = (np.asarray(c) for c in batch.columns)
            if not len(sig):
                continue
            begin = np.concatenate([[True], sig[1:] != sig[:-1]])
            lead = node[np.maximum.accumulate(np.where(begin, np.arange(len(sig)), 0))]
            if last_sig is not None and sig[0] == last_sig:
                upto = np.argmax(sig != last_sig) or len(sig)
                lead[:upto] = leader
            last_sig, leader = sig[-1], lead[-1]
            other = lead != node
            if other.any():
                pairs = np.unique(np.stack([lead[other], node[other]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["leader", "node"])

    rows = docs.select(F.col(text).cast("binary").alias("t")).where(F.length("t") > 0).mapInArrow(signed, "sig long, node long")
    rows = rows.repartition("sig").sortWithinPartitions("sig", "node")
    return rows.mapInArrow(leaders, "leader long, node long").distinct()


def linked(size_a, size_b, differ, num: int, den: int):
    """Whether sets of these sizes with so many differing shingles link."""
    return den * (size_a + size_b - differ) >= num * (size_a + size_b + differ)


def group_links(leader: int, leader_set: np.ndarray, members: list[tuple[int, bool, np.ndarray]], num: int, den: int):
    """Links of a leader and of its members that join components of the group; members: (node, side, set).

    Every pair of members on different sides (or of the one side) is decided exactly, but for pairs
    that are both linked to the leader.
    """
    nodes = np.array([m[0] for m in members])
    side = np.array([m[1] for m in members])
    size = np.array([len(m[2]) for m in members])
    differ = [np.setxor1d(m[2], leader_set, assume_unique=True) for m in members]
    x = np.array([len(d) for d in differ])
    near = linked(size, len(leader_set), x, num, den)
    out = [(leader, int(v)) for v in nodes[near]]
    rest = np.flatnonzero(~near)
    if len(rest) == 0 or len(members) < 2:
        return out
    parent = list(range(len(members)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    joined = np.flatnonzero(near)
    for i in joined:
        parent[i] = int(joined[0])
    owner = np.repeat(np.arange(len(members)), x)
    feature = np.concatenate(differ)
    order = np.argsort(feature, kind="stable")
    owner, feature = owner[order], feature[order]
    begin = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]]))
    count = np.diff(np.append(begin, len(feature)))
    begin, count, known = begin[count > 1], count[count > 1], feature[begin[count > 1]]
    one_side = side.all() or not side.any()
    for u in rest:
        at = np.searchsorted(known, differ[u])
        at = at[at < len(known)]
        if len(known) and len(differ[u]):
            full = np.searchsorted(known, differ[u])
            full[full == len(known)] = 0
            at = full[known[full] == differ[u]]
        lists = [owner[begin[i]:begin[i] + count[i]] for i in at]
        shared = np.bincount(np.concatenate(lists), minlength=len(members)) if lists else np.zeros(len(members), np.int64)
        ok = linked(size[u], size, x[u] + x - 2 * shared, num, den)
        ok[u] = False
        if not one_side:
            ok &= side != side[u]
        for v in np.flatnonzero(ok):
            if (a := find(u)) != (b := find(int(v))):
                parent[a] = b
                out.append((int(nodes[u]), int(nodes[v])))
    return out


def links(docs: DataFrame, table: DataFrame, pairs: DataFrame, doc_id: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """(a, b): verified links that span every component."""
    nodes = pairs.select("node").union(pairs.select("leader")).distinct()
    first = saved(table.where("n_shingles > 0").join(nodes, "node").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size")))
    ids = first.select("doc_id").distinct()
    ids = bounded(ids, ids.limit(BROADCAST_IDS + 1).count())
    chosen = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("binary").alias("t")).join(
        ids, F.col("d").eqNullSafe(F.col("doc_id")), "left_semi").select("t")

    held = chosen.withColumn("node", node_column("t", n)).dropDuplicates(["node"])  # texts take less room than hashes
    sized = pairs.join(first.select("node", "size"), "node")
    split = sized.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    members = pairs.join(split, "leader").withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).withColumn(
        "o", F.explode(F.expr("sequence(0, nb - 1)"))).select(
        "leader", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).alias("side"), "node", F.lit(1).alias("m"))
    heads = split.withColumn("i", F.explode(F.expr("sequence(0, nb - 1)"))).withColumn("j", F.explode(F.expr("sequence(i, nb - 1)"))).select(
        "leader", "i", "j", F.lit(False).alias("side"), F.col("leader").alias("node"), F.lit(0).alias("m"))
    rows = members.unionByName(heads).join(held, "node").select("leader", "i", "j", "m", "side", "node", "t")
    rows = rows.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "m")

    def verified(batches):
        key, head, members = None, None, []

        def done():
            found = group_links(key[0], head, members, num, den) if members else []
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            found = sets(batch.column("t").to_pylist(), n)
            for shingles, row in zip(found, zip(*(batch.column(c).to_pylist() for c in ("leader", "i", "j", "m", "side", "node")))):
                if row[:3] != key:
                    if key:
                        yield done()
                    key, head, members = row[:3], None, []
                if row[3] == 0:
                    head = shingles
                else:
                    members.append((row[5], row[4], shingles))
        if key:
            yield done()

    return rows.mapInArrow(verified, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component, of every node that has a link."""
    both = saved(edges.union(edges.select("b", "a")).toDF("node", "other").distinct())
    labels = saved(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels.toDF("other", "theirs"), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "theirs").alias("new"))
        ahead = labels.toDF("new", "further")
        step = saved(step.join(ahead, "new").select("node", "label", F.least("new", "further").alias("new")))
        changed = step.where("new < label").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, node, group, component_id) of every row; ``group`` is the component's label (null: the empty set)."""
    table = saved(described(docs, doc_id, text, shingle))
    pairs = saved(led(docs, text, shingle, num, den))
    label = components(links(docs, table, pairs, doc_id, text, shingle, num, den))
    grouped = table.join(label, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("label", "node").alias("group"))
    least = grouped.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    return grouped.join(least, "group", "left").select(
        "doc_id", "n_shingles", "node", "group", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without near duplicates: of every component the row of the smallest id (and node) stays, one of equal rows.

    Rows leave by their ids, which most tables have once; rows of repeated ids are told apart by their nodes.
    """
    table = saved(join(docs, doc_id, text, **options).select("doc_id", "node", "group"))
    rows, names = positional(docs)
    d, t = names[doc_id], names[text]
    again = saved(table.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"))
    kept = table.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("k"))
    kept = saved(kept.select("group", F.col("k.doc_id").alias("kept_id"), F.col("k.node").alias("kept_node")))
    gone = table.join(kept, "group").where(~F.col("doc_id").eqNullSafe(F.col("kept_id"))).select(F.col("doc_id").alias("gone"))
    gone = saved(gone.join(again, F.col("gone").eqNullSafe(F.col("doc_id")), "left_anti"))
    same_id = F.col(d).eqNullSafe(F.col("doc_id"))
    repeats = again.limit(BROADCAST_IDS + 1).count()
    single = rows.join(bounded(again, repeats), same_id, "left_anti") if repeats else rows
    single = single.join(bounded(gone, gone.limit(BROADCAST_IDS + 1).count()), F.col(d).eqNullSafe(F.col("gone")), "left_anti")
    if not repeats:
        return restored(single, names)
    told = rows.join(bounded(again, repeats), same_id, "left_semi").withColumn("n", node_column(t, options.get("shingle", SHINGLE)))
    one = told.where("n is not null").join(kept, F.col(d).eqNullSafe(F.col("kept_id")) & (F.col("n") == F.col("kept_node")), "left_semi")
    one = one.dropDuplicates([d, "n"]).unionByName(told.where("n is null"))
    return restored(single.unionByName(one.drop("n")), names)


def bounded(ids: DataFrame, n: int) -> DataFrame:
    """``ids`` to be broadcast when ``n`` of them are few enough."""
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids
