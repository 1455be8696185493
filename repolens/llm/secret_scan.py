"""Secret scan with a random forest that removes false positives.

Candidates are runs of ``MIN_LENGTH`` or more characters of ``[A-Za-z0-9_+/=-]``
that hold a digit, two capitals, or stand behind an assignment. Each gets
features, over the whole of it: length and character classes, the mean log probability of its
character transitions and the least mean of a piece of ``PIECE`` of them, the share of it that dictionary words cover, the path of its text, and its
neighbouring words. Transitions and dictionary come from all texts. The forest is trained
from labelled findings, at most ``TRAIN_ROWS`` of each label in hash order, one
tree a Spark task on its own bootstrap, and findings scored under ``KEEP`` are removed.

``labelled`` gives the labels when no table of findings is passed: well-known key
formats and assigned mixed strings are secrets; plain numbers, words and
names are not; other candidates have no label and are left to the forest. Which rule a
label came from is no feature.

Null and empty texts have no candidates; very long texts are scanned whole; equal texts
of one path get equal findings; a null path counts as the empty one; repeated rows get a row
each; without findings of both labels all candidates are kept (score 1). An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import hashing
from .common import commonest, hash_sample, saved, short_batches, word_counts

MIN_LENGTH, PIECE = 14, 32
RUN = re.compile(r"[A-Za-z0-9_+/=\-]{%d,}" % MIN_LENGTH)
#: Names that secrets are assigned to, and words of examples.
KEY_WORDS = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "auth", "credential", "bearer")
EXAMPLE_WORDS = ("example", "sample", "dummy", "test", "placeholder", "changeme", "xxxx", "todo")
#: Formats of well-known keys, for labels only.
FORMATS = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk)[-_](?:live_|test_)?[A-Za-z0-9]{20,}|gsk_[A-Za-z0-9]{20,}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abpr]-[A-Za-z0-9-]{10,}")
DICTIONARY, LONGEST = 20_000, 24  # words, and bytes of a word at most
TRAIN_ROWS, TREES, DEPTH, LEAF = 8000, 40, 10, 4
KEEP = 0.5
N_PATHS, N_NEIGHBOURS = 4, 8
CELLS = 256 * 256


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates; a run is cut at its first ``=`` when a name stands before it."""
    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        assigned = False
        if 0 < (cut := text.find("=", a, b) + 1) - a < b - a and text[a:cut - 1].replace("_", "").replace("-", "").isalpha():
            a, assigned = cut, True
        else:
            assigned = text[max(0, a - 4):a].rstrip(" \"'").endswith(("=", ":"))
        while b > a and text[b - 1] in "=-" and not assigned:
            b -= 1
        s = text[a:b]
        if b - a >= MIN_LENGTH and (assigned or any(c.isdigit() for c in s) or sum(c.isupper() for c in s) >= 2):
            out.append((a, b))
    return out


NEIGHBOUR = re.compile(r"[^\W\d]+")


@lru_cache(maxsize=2)
def word_places(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the words of a text, found once for all its candidates."""
    spans = [m.span() for m in NEIGHBOUR.finditer(text)]
    return [a for a, _ in spans], [b for _, b in spans]


def around(text: str, a: int, b: int) -> tuple[str, list[str], list[str]]:
    """What stands right before the candidate (its end, from the last character that isn't blank on), and the two whole words
    before and behind it, however long or far away."""
    k = a
    if k and text[k - 1] in "\"'":
        k -= 1
    while k and text[k - 1].isspace():
        k -= 1
    starts, ends = word_places(text)
    n, m = bisect_left(starts, a), bisect_right(ends, b)
    left = [text[starts[i]:min(ends[i], a)].lower() for i in range(max(0, n - 2), n)]
    return text[max(0, k - 1):a], left, [text[max(starts[i], b):ends[i]].lower() for i in range(m, min(m + 2, len(ends)))]


def features(text: str, path: str, a: int, b: int, transitions: np.ndarray, dictionary: dict[bytes, int]) -> list[float]:
    s = text[a:b]
    raw, n = s.encode(), b - a
    codes = np.frombuffer(raw, np.uint8).astype(np.int64)
    lower = raw.lower()
    covered, i = 0, 0
    while i < len(lower):  # greedy cover by dictionary words of four letters or more
        for size in range(min(LONGEST, len(lower) - i), 3, -1):
            if lower[i:i + size] in dictionary:
                covered += size
                i += size
                break
        else:
            i += 1
    steps = transitions[codes[:-1] * 256 + codes[1:]]
    sums, piece = np.append(0.0, np.cumsum(steps)), min(PIECE, len(steps))
    before, left, right = around(text, a, b)
    counts = np.bincount(codes, minlength=256)
    share = counts[counts > 0] / len(codes)
    digits, upper, lows = (sum(map(f, s)) / n for f in (str.isdigit, str.isupper, str.islower))
    tail = before.rstrip()
    out = [
        np.log(n), digits, upper, lows, sum(c in "abcdef0123456789" for c in s) / n, -(share * np.log2(share)).sum(), len(share) / len(codes),
        float(steps.mean()), float(steps.min()), float((sums[piece:] - sums[:-piece]).min() / piece), covered / len(lower),
        sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:])) / n, float(s[:1].isupper()), float(tail.endswith("=")), float(tail.endswith(":")),
        float(before[-1:] in ("'", '"')), float(before[-1:].isspace()), float(text[b:b + 1].isspace() or b == len(text)),
        float(any(w in KEY_WORDS or w.endswith(("key", "token", "secret")) for w in left)), float(any(w in EXAMPLE_WORDS for w in left + right)),
        np.log1p(dictionary.get(left[-1].encode(), DICTIONARY) if left else -0.5), np.log1p(dictionary.get(right[0].encode(), DICTIONARY) if right else -0.5),
        float(bool(re.search(r"test|example|sample|fixture|doc|mock", path, re.I))),
    ]
    place, near = zlib.crc32(path.encode()) % N_PATHS, zlib.crc32((left[-1] if left else "").encode()) % N_NEIGHBOURS
    return out + [float(i == place) for i in range(N_PATHS)] + [float(i == near) for i in range(N_NEIGHBOURS)]


N_FEATURES = 23 + N_PATHS + N_NEIGHBOURS


def labelled(text: str, a: int, b: int) -> int | None:
    """The label of a candidate where a rule is sure of it: 1 a secret, 0 none."""
    s = text[a:b]
    before, left, _ = around(text, a, b)
    mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
    if FORMATS.fullmatch(s):
        return 1
    if mixed and left and left[-1] in KEY_WORDS and re.search(r"[=:]\s*[\"']?$", before):
        return 1
    if s.isdigit() or s.isalpha() or re.fullmatch(r"[A-Za-z]+([_\-/=+][A-Za-z]+)*", s) or re.fullmatch(r"[0-9]+([_\-/][0-9]+)*", s):
        return 0
    return None


def statistics(texts: DataFrame) -> tuple[np.ndarray, dict[bytes, int]]:
    """Log probabilities of character transitions and the rank of the commonest words, from all texts (one binary column)."""

    def pairs(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            values = batch.column(0).to_pylist()
            for i, j in hashing.chunks(values):
                codes = np.frombuffer(b"\n".join(t for t in values[i:j] if t), np.uint8).astype(np.int32)
                if len(codes) > 1:
                    total += np.bincount(codes[:-1] * 256 + codes[1:], minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "c"])

    counts = np.full(CELLS, 0.5)
    for cell, c in texts.mapInArrow(pairs, "cell int, c long").groupBy("cell").agg(F.sum("c")).collect():  # at most CELLS rows
        counts[cell] += c
    table = counts.reshape(256, 256)
    words = saved(word_counts(texts).where((F.length("word") >= 2) & (F.length("word") <= 24)))
    return np.log(table / table.sum(1, keepdims=True)).ravel(), {w: i for i, (w, _) in enumerate(commonest(words, DICTIONARY))}


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """A tree as (feature, threshold, left, right, share of label 1); feature -1 is a leaf."""
    nodes: list = []

    def node(rows, depth):
        at, p = len(nodes), float(y[rows].mean())
        nodes.append((-1, 0.0, 0, 0, p))
        if depth == DEPTH or len(rows) < 2 * LEAF or p in (0.0, 1.0):
            return at
        found = (p * (1 - p) * len(rows) - 1e-9, None, None)
        for f in rng.choice(x.shape[1], int(np.sqrt(x.shape[1])) + 1, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(v))
            cut = (v[1:] > v[:-1]) & (n >= LEAF) & (len(v) - n >= LEAF)
            if cut.any():
                a, b = ones[:-1], ones[-1] - ones[:-1]
                loss = np.where(cut, a * (n - a) / n + b * (len(v) - n - b) / (len(v) - n), np.inf)
                if (k := int(loss.argmin())) >= 0 and loss[k] < found[0]:
                    found = (loss[k], f, (v[k] + v[k + 1]) / 2)
        if found[1] is None:
            return at
        left = x[rows, found[1]] <= found[2]
        nodes[at] = (int(found[1]), float(found[2]), node(rows[left], depth + 1), node(rows[~left], depth + 1), p)
        return at

    node(rng.integers(0, len(y), len(y)), 0)
    return nodes


def columns(tree: list[tuple]) -> tuple[np.ndarray, ...]:
    return tuple(np.array(c) for c in zip(*tree))


def votes(forest: list[list[tuple]], x: np.ndarray) -> np.ndarray:
    """Mean share of label 1 over the trees."""
    total = np.zeros(len(x))
    for tree in forest:
        f, t, a, b, p = tree if isinstance(tree, tuple) else columns(tree)
        at = np.zeros(len(x), int)
        for _ in range(DEPTH):
            inner = f[at] >= 0
            if not inner.any():
                break
            left = x[np.arange(len(x)), np.maximum(f[at], 0)] <= t[at]
            at = np.where(inner, np.where(left, a[at], b[at]), at)
        total += p[at]
    return total / len(forest)


def train(x: np.ndarray, y: np.ndarray, spark) -> list[list[tuple]]:
    """The forest, a tree a task."""
    data = spark.sparkContext.broadcast((x, y))

    def trees(batches):
        for batch in batches:
            grown = [pickle.dumps(grow(*data.value, np.random.default_rng(i))) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(grown, pa.binary())], ["tree"])

    return [pickle.loads(r.tree) for r in spark.range(0, TREES, 1, TREES // 4).mapInArrow(trees, "tree binary").collect()]


def described(docs: DataFrame, text: str, path: str, shared, also_labels: bool) -> DataFrame:
    """``docs`` with ``found``: start, end, features and label of the candidates, for training those with a sure label."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("x", pa.list_(pa.float64())), ("label", pa.int32())]))

    @arrow_udf("array<struct<start: int, end: int, x: array<double>, label: int>>")
    def found(texts: pa.Array, paths: pa.Array) -> pa.Array:
        out = []
        for t, p in zip(texts.to_pylist(), paths.to_pylist()):
            rows = []
            for a, b in candidates(t or ""):
                label = labelled(t, a, b) if also_labels else None
                if not also_labels or label is not None:
                    rows.append({"start": a, "end": b, "x": features(t, p or "", a, b, *shared.value), "label": label})
            out.append(rows)
        return pa.array(out, kind)

    return docs.withColumn("found", found(F.col(text), F.col(path)))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source", findings: DataFrame | None = None,
         keep: float = KEEP) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, findings, top_score) of every row; ``findings`` lists start:end in code points.

    A table ``findings`` (x: array<double> as ``features`` makes it, label: int) replaces the built-in labels.
    """
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.col(path).cast("string").alias("p"))
    shared = spark.sparkContext.broadcast(statistics(docs.select(F.col("t").cast("binary"))))
    if findings is None:
        findings = described(docs, "t", "p", shared, True).select(F.explode("found").alias("f")).select("f.x", "f.label")
    rows = saved(findings.select("x", "label", F.xxhash64("x").alias("h")).groupBy("h", "label").agg(F.first("x").alias("x")))
    sample = [r for y in (0, 1) for r in hash_sample(rows.where(F.col("label") == y), "h", TRAIN_ROWS).collect()]
    x, y = np.array([r.x for r in sample], float).reshape(-1, N_FEATURES), np.array([r.label for r in sample], float)
    forest = spark.sparkContext.broadcast([columns(t) for t in train(x, y, spark)] if 0 < y.sum() < len(y) else None)

    def kept(batches):
        for batch in batches:
            out = []
            for t, p in zip(batch.column("t").to_pylist(), batch.column("p").to_pylist()):
                spans = candidates(t or "")
                x = np.array([features(t, p or "", a, b, *shared.value) for a, b in spans], float).reshape(-1, N_FEATURES)
                score = votes(forest.value, x) if forest.value and spans else np.ones(len(spans))
                good = [f"{a}:{b}" for (a, b), v in zip(spans, score) if v >= keep]
                out.append((len(spans), len(good), ",".join(good), float(score.max()) if spans else None))
            cols = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("d"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.float64())))],
                                             ["d", "n_candidates", "n_secrets", "findings", "top_score"])

    kind = docs.schema["d"].dataType.simpleString()
    return docs.mapInArrow(
        kept, f"d {kind}, n_candidates long, n_secrets long, findings string, top_score double").withColumnRenamed("d", doc_id)
