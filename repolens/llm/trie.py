"""The prefix trie of conversations, built as a burst trie.

A conversation is a sequence of turn ids (digests of role and text). The trie's upper
part are *heads*; below a head each next turn id opens a *container* that holds the
suffixes of its conversations as plain rows. Starting from the root, which always
bursts, a container with several conversations and more than ``capacity`` rows bursts:
its prefix becomes a head, and its suffixes go to new containers by next turn id.
A round bursts one turn id deep, later rounds twice as many each time, so even long sequences
with very many copies take few rounds. The containers that remain are dealt to tasks, sorted, and
swept: neighbours' common prefixes open and close the nodes, and a stack sums up
conversations, children, leaves and saved tokens. A container of one conversation is a
chain, whose nodes are its rows. Sums of containers are added up along the paths of the heads.

Spark does all of the dealing: turns are numbered by one sort by (conversation, turn)
in ranges, so a conversation of any length is cut between tasks and only the
edges of ranges, a few rows each, meet on the driver. Heads are few (each has more than
``capacity`` rows below it at its depth); they are joined, not held. The ids that end at a head are sorted in ranges,
joined to text in parts, and only hashed in one task.

Before that, ``rebuild`` gives every conversation the first turns of another one (see there).

Turns are ordered by number, null first, ties by digest. Null roles and texts are
empty, rows without a conversation id belong to none and are left out, repeated rows are turns of
their own, texts of any length count whole, an empty table gives an empty result, and further
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

MOST, LEAST = 50_000, 512   # rows of a container: a share of all rows between these
SHARE = 4                   # containers that a task would get if all were full
STRIDE = 64                 # turns that a round bursts at most
SHARED_HEADS = 100_000      # heads of a round that are joined by broadcast; more go by shuffle
GROUP, SHARED_TURNS = 20, 4
CHUNK = 1 << 16
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
NAMES = [f.split()[0] for f in NODE.split(", ")]
EMPTY = hashlib.sha256(b"").hexdigest()


# ---- sequences ---------------------------------------------------------------------------

def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, t, id, words), saved: turn ids of 128 bits and the words of the text."""
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    name = F.concat(F.length(who).cast("string"), F.lit(":"), who, said)
    return saved(conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("t"), F.substring(F.sha2(name, 256), 1, 32).alias("id"),
        F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")))


def rebuild(rows: DataFrame, group: int = GROUP, shared: int = SHARED_TURNS) -> DataFrame:
    """(c, pos, id, words), saved: the first ``h`` turns of conversation ``c - c % group`` and then ``c``'s own behind its
    first ``h``, numbered from 1; ``h`` is crc32 of the decimal id modulo ``shared``. A row at 0 stands for the conversation itself."""
    donor = F.col("c") - F.col("c") % group
    first = F.row_number().over(Window.partitionBy("c").orderBy("t", "id"))
    donors = rows.where(F.col("c") % group == 0).select(F.col("c").alias("donor"), first.alias("n"), "id", "words").where(F.col("n") < shared)
    convs = rows.select("c").distinct().withColumn("h", (F.crc32(F.col("c").cast("string")) % shared).cast("long"))
    heads = convs.withColumn("donor", donor).join(donors, "donor").where(F.col("n") <= F.col("h"))
    kind = rows.schema["t"].dataType
    none = F.lit(None)
    everything = rows.select("c", F.lit(2).alias("k"), "t", F.lit(0).cast("long").alias("n"), "id", "words").unionByName(
        heads.select("c", F.lit(1).alias("k"), none.cast(kind).alias("t"), F.col("n").cast("long").alias("n"), "id", "words")).unionByName(
        convs.select("c", F.lit(0).alias("k"), none.cast(kind).alias("t"), F.col("h").alias("n"), none.cast("string").alias("id"),
                     F.lit(0).cast("long").alias("words")))
    order = ["c", "k", "t", "n", "id"]

    def numbered(batches):
        """The place of own turns in this task; ranges are in order, so a conversation's parts are."""
        part, c, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for now, k, n in zip(*(batch.column(x).to_pylist() for x in ("c", "k", "n"))):
                if now != c:
                    c, at = now, 0
                at += k == 2
                places.append(at if k == 2 else n)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(places), pa.int32()), batch.column("c"), batch.column("k"), pa.array(places, pa.int64()),
                                              batch.column("id"), batch.column("words")], ["part", "c", "k", "n", "id", "words"])

    placed = saved(everything.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        numbered, "part int, c long, k int, n long, id string, words long"))
    before = rows.sparkSession.sparkContext.broadcast(_before(placed))

    def joined(batches):
        c, h, heads, own = None, 0, 0, 0
        for batch in batches:
            keep, pos = [], []
            for i, (part, now, k, n) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("part", "c", "k", "n")))):
                if now != c:
                    c, (h, heads, own) = now, before.value.get((part, now), (0, 0, 0))
                if k == 0:
                    h, at = n, 0
                elif k == 1:
                    heads, at = heads + 1, n
                else:
                    if own + n <= h:
                        continue
                    at = heads + own + n - h
                keep.append(i)
                pos.append(at)
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("c"), pa.array(pos, pa.int64()), kept.column("id"), kept.column("words")], ["c", "pos", "id", "words"])

    return saved(placed.mapInArrow(joined, "c long, pos long, id string, words long"))


def _before(placed: DataFrame) -> dict[tuple[int, int], tuple[int, int, int]]:
    """For a conversation that goes on from earlier ranges: (range, conversation) -> its h, shared turns and own turns before.
    At most two conversations a range are looked at, its first and its last."""
    edges = placed.groupBy("part").agg(F.min("c").alias("a"), F.max("c").alias("b")).collect()
    count: dict[int, int] = {}
    for e in edges:
        for c in {e.a, e.b}:
            count[c] = count.get(c, 0) + 1
    cut = [(c,) for c, n in count.items() if n > 1]
    if not cut:
        return {}
    found = placed.join(F.broadcast(placed.sparkSession.createDataFrame(cut, "c long")), "c").groupBy("c", "part").agg(
        F.coalesce(F.max(F.when(F.col("k") == 0, F.col("n"))), F.lit(0)).alias("h"), F.count_if(F.col("k") == 1).alias("heads"),
        F.count_if(F.col("k") == 2).alias("own")).collect()
    out, c = {}, None
    for r in sorted(found, key=lambda r: (r.c, r.part)):
        if r.c != c:
            c, sums = r.c, (0, 0, 0)
        out[r.part, c] = sums
        sums = (sums[0] + r.h, sums[1] + r.heads, sums[2] + r.own)
    return out


# ---- bursting ----------------------------------------------------------------------------

def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for a broadcast if it has few rows; else Spark shuffles, and splits hot keys."""
    return F.broadcast(df) if rows <= SHARED_HEADS else df


def _burst(rows: DataFrame, lengths: DataFrame, capacity: int):
    """(heads, containers, ends): heads with their path; the container of every conversation that doesn't end at a head; who ends at one."""
    whole = lengths.agg(F.count("*").alias("n"), F.min("c").alias("least")).first()
    spark = rows.sparkSession
    no_path = F.array().cast("array<string>")
    heads = [spark.createDataFrame([(0, "", whole.n, whole.least, 0, None)], "depth long, key string, n long, least long, words long, parent string")
             .withColumn("path", no_path)]
    state = lengths.select("c", "len", F.lit("").alias("key"), no_path.alias("path"))
    containers, ends = [], [state.where("len = 0").select("key", "c")]
    state, depth, stride = state.where("len > 0"), 0, 1
    while True:
        steps = rows.where(F.col("pos").between(depth + 1, depth + stride)).groupBy("c").agg(
            F.array_sort(F.collect_list(F.struct("pos", "id", "words"))).alias("x"))  # at most ``stride`` rows each
        key = lambda j: F.substring(F.sha2(F.concat("key", F.array_join(F.slice("ids", F.lit(1), j), "")), 256), 1, 32)
        walked = steps.join(state, "c").withColumn("ids", F.transform("x", lambda e: e["id"])).withColumn(
            "keys", F.concat(F.array("key"), F.transform(F.sequence(F.lit(1), F.size("ids")), key)))
        at = F.col("j") + 1
        tried = saved(walked.select("c", "len", "path", "x", "keys", F.posexplode("ids").alias("j", "id")).select(
            "c", "len", (at + depth).cast("long").alias("depth"), F.get("keys", at).alias("key"), F.get("keys", F.col("j")).alias("parent"),
            F.get("x", F.col("j"))["words"].alias("words"), F.concat("path", F.slice("keys", 1, at)).alias("path")))
        nodes = saved(tried.groupBy("key").agg(
            F.first("depth").alias("depth"), F.count("*").alias("n"), F.min("c").alias("least"), F.first("words").alias("words"),
            F.first("parent").alias("parent"), F.first("path").alias("path"), F.sum(F.col("len") - F.col("depth") + 1).alias("rows")))
        full = saved(nodes.where((F.col("n") > 1) & (F.col("rows") > capacity)).drop("rows"))
        count = full.count()
        heads.append(full.select(heads[0].columns))
        marked = tried.join(small(full.select("key", F.lit(True).alias("full")), count), "key", "left")
        top = F.min(F.struct("depth", "key"))
        containers.append(marked.where("full is null").groupBy("c").agg(top.alias("top")).select("c", "top.*")
                          .join(nodes.where((F.col("n") == 1) | (F.col("rows") <= capacity)).select("key", "n", "parent"), "key"))
        if not count:
            break
        passed = saved(marked.where("full").select("c", "len", "depth", "key", "path"))
        ends.append(passed.where("depth = len").select("key", "c"))
        depth += stride
        state = passed.where((F.col("depth") == depth) & (F.col("len") > depth)).select("c", "len", "key", "path")
        if state.isEmpty():
            break
        stride = min(STRIDE, 2 * stride)
    union = lambda parts: parts[0] if len(parts) == 1 else union([a.unionByName(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) & ~1:])
    return saved(union(heads)), union(containers), union(ends)


def sweep(sequences: list[list[str]], convs: list[int], words: list[list[int]], depth: int, parent: int) -> list[tuple]:
    """Nodes of a container's suffixes, which share their first turn, of depth ``depth``: sorted, then swept by common prefixes."""
    order = sorted(range(len(convs)), key=lambda i: (sequences[i], convs[i]))
    out: list[list] = []
    stack: list[list] = []  # least, n, children (their places in out), leaves, saved, ends, words

    def close():
        least, n, children, leaves, kept, ends, size = stack.pop()
        kept += (n - 1) * size
        leaves = leaves or 1
        for i in children:
            out[i][2] = least
        out.append([least, depth + len(stack), parent, n, len(children), leaves, kept,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else EMPTY])
        if stack:
            up = stack[-1]
            up[0], up[1], up[3], up[4] = min(up[0], least), up[1] + n, up[3] + leaves, up[4] + kept
            up[2].append(len(out) - 1)

    last: list[str] = []
    for i in order:
        now, same = sequences[i], 0
        for a, b in zip(last, now):
            if a != b:
                break
            same += 1
        while len(stack) > same:
            close()
        for j in range(same, len(now)):
            stack.append([convs[i], 0, [], 0, 0, [], words[i][j]])
        top = stack[-1]
        top[0], top[1] = min(top[0], convs[i]), top[1] + 1
        top[5].append(convs[i])
        last = now
    while stack:
        close()
    return [tuple(x) for x in out]


def _swept(suffixes: DataFrame) -> DataFrame:
    """Nodes of all containers with several conversations, and the head that each container hangs on."""
    columns = ["key", "c", "pos", "id", "words", "depth", "parent", "parent_conv"]

    def run(batches):
        key, info, convs, seqs, words, out = None, None, [], [], [], []

        def done():
            return [(*n, info[1] if n[1] == info[0] else None) for n in sweep(seqs, convs, words, info[0], info[2])]

        def batch_of(rows):
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [*NAMES, "head"])

        for batch in batches:
            for k, c, _, i, w, d, head, up in zip(*(batch.column(x).to_pylist() for x in columns)):
                if k != key:
                    if convs:
                        out += done()
                    if len(out) > 10_000:
                        yield batch_of(out)
                        out = []
                    key, info, convs, seqs, words = k, (d, head, up), [], [], []
                if not convs or convs[-1] != c:
                    convs.append(c)
                    seqs.append([])
                    words.append([])
                seqs[-1].append(i)
                words[-1].append(w)
        if convs:
            out += done()
        if out:
            yield batch_of(out)

    dealt = suffixes.select(columns).repartition("key").sortWithinPartitions("key", "c", "pos")
    return dealt.mapInArrow(run, f"{NODE}, head string")


def _digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): ids sorted in ranges and joined to text there; one task a key hashes the parts in order."""
    def texts(batches):
        part, key, held, size, number, out = TaskContext.get().partitionId(), None, [], 0, 0, []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.string()))],
                                              ["key", "part", "number", "ids"])

        for batch in batches:
            for k, c in zip(*(batch.column(x).to_pylist() for x in ("key", "c"))):
                if held and (k != key or size > CHUNK):
                    out.append((key, part, number, ",".join(held)))
                    held, size, number = [], 0, number + 1
                    if len(out) >= 100:
                        yield batch_of(out)
                        out = []
                key = k
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            out.append((key, part, number, ",".join(held)))
        if out:
            yield batch_of(out)

    def hashed(batches):
        key, sha, out = None, None, []
        for batch in batches:
            for k, ids in zip(*(batch.column(x).to_pylist() for x in ("key", "ids"))):
                if sha is not None and k == key:
                    sha.update(b",")
                else:
                    if sha is not None:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                sha.update(ids.encode())
        if sha is not None:
            out.append((key, sha.hexdigest()))
        for a in range(0, len(out), 10_000):
            k, x = zip(*out[a:a + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(x, pa.string())], ["key", "ends_sha256"])

    parts = ends.repartitionByRange("key", "c").sortWithinPartitions("key", "c").mapInArrow(texts, "key string, part int, number long, ids string")
    return parts.repartition("key").sortWithinPartitions("key", "part", "number").mapInArrow(hashed, "key string, ends_sha256 string")


def nodes(rows: DataFrame, capacity: int | None = None) -> DataFrame:
    """All nodes of the trie of the sequences (c, pos, id, words): ``NODE``'s columns, a row each."""
    spark = rows.sparkSession
    lengths = saved(rows.groupBy("c").agg(F.max("pos").alias("len")))
    total = lengths.agg(F.sum(F.col("len") + 1)).first()[0]
    if not total:
        return spark.createDataFrame([], NODE)
    if capacity is None:
        capacity = int(np.clip(total // (SHARE * int(spark.conf.get("spark.sql.shuffle.partitions"))), LEAST, MOST))
    heads, containers, ends = _burst(rows, lengths, capacity)
    n_heads = heads.count()
    up = small(heads.select(F.col("key").alias("parent"), F.col("least").alias("parent_conv")), n_heads)
    held = saved(containers.join(up, "parent"))
    suffixes = saved(rows.join(held, "c").where(F.col("pos") >= F.col("depth")))
    alone = suffixes.where("n = 1").join(lengths, "c")
    is_top, is_end = F.col("pos") == F.col("depth"), F.col("pos") == F.col("len")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    chains = alone.select(
        F.col("c").alias("conv_id"), F.col("pos").alias("depth"), F.when(is_top, F.col("parent_conv")).otherwise(F.col("c")).alias("parent_conv_id"),
        one.alias("n_convs"), F.when(is_end, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(is_end, F.sha2(F.col("c").cast("string"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"), F.when(is_top, F.col("parent")).alias("head"))
    below = saved(_swept(suffixes.where("n > 1")).unionByName(chains))
    return below.drop("head").unionByName(_heads(heads, below, ends))


def _heads(heads: DataFrame, below: DataFrame, ends: DataFrame) -> DataFrame:
    """The heads' nodes: sums of their containers, added up along the paths."""
    hung = below.where("head is not null").groupBy(F.col("head").alias("key")).agg(
        F.count("*").alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    inner = heads.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("inner"))
    zero = F.lit(0).cast("long")
    filled = lambda c: F.coalesce(F.col(c), zero)
    own = saved(heads.join(hung, "key", "left").join(inner, "key", "left").join(_digests(ends), "key", "left").select(
        "key", "depth", "n", "least", "parent", "path", (filled("tops") + filled("inner")).alias("children"),
        F.coalesce("leaves", F.when(F.col("inner").isNull(), F.lit(1)).otherwise(0)).cast("long").alias("leaves"),
        (filled("saved") + (F.col("n") - 1) * F.col("words")).alias("saved"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))
    sums = own.select(F.explode(F.concat("path", F.array("key"))).alias("key"), "leaves", "saved").groupBy("key").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = own.select(F.col("key").alias("parent"), F.col("least").alias("parent_conv_id"))
    return own.join(sums, "key").join(above, "parent", "left").select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        "n_leaves", "saved_tokens", "ends_sha256")


def build(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
          capacity: int | None = None) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations."""
    return nodes(rebuild(turns(conversations, conv, turn, role, text)), capacity)
