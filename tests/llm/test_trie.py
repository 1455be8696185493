"""The burst trie against a dictionary of all prefixes, at several capacities and however the rows lie."""

import hashlib
import random
import zlib

import pytest

from repolens.llm import trie

COLUMNS = "conv_id long, turn long, role string, text string, key string, depth int"


def plain(rows):
    """Every node by its prefix, from lists of turns."""
    held = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            held.setdefault(c, []).append(((t is not None, t or 0, name[:32]), role, text))
    lists = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in held.items()}
    whole = {}
    for c, own in lists.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - int(abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = lists.get(donor, [])[:h] + own[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    saved, leaves = {}, {}
    words = lambda t: sum(map(bool, "".join(" " if ord(x) == 32 or 9 <= ord(x) <= 13 else x for x in t).split(" ")))
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        saved[p] = (len(members[p]) - 1) * (words(p[-1][1]) if p else 0) + sum(saved[x] for x in below)
        leaves[p] = sum(leaves[x] for x in below) or 1
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p],
          hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)).encode()).hexdigest()) for p, m in members.items()), key=str)


def cases():
    rng = random.Random(3)
    texts = ["hi", "a b  c", "", None, "tab\there\x0bx", "é ü", "x" * 2000, "a\xa0b c"]
    rows = []
    for c in [*range(70), 400, 401, 417, -3, -25, 2**40]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "user", None]), rng.choice(texts), "k", 1))
    for c in range(1000, 1060):  # copies of one conversation, a long one among them
        rows += [(c, t, "user", f"turn {t} said", "k", 1) for t in range(6)]
    rows += [(c, t, "user", f"long {t}", "k", 1) for c in (1203, 1206, 1216) for t in range(90)]
    rows += [(None, 1, "user", "lost", "k", 1), rows[0], rows[1], (5, 2, "", "", "k", 1)]
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("capacity", [None, 1, 40])
def test_against_all_prefixes(spark, capacity):
    rows = cases()
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert result(trie.build(df, capacity=capacity)) == plain(rows)


def test_conversations_cut_between_ranges(spark):
    rows = [(c, t, "user", f"{t} {c if t > 50 else 0}", "k", 1) for c in (3, 6, 17) for t in range(400)]
    df = spark.createDataFrame(rows, COLUMNS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        sequences = trie.rebuild(trie.turns(df))
        assert sequences.groupBy("c").count().count() == 3
        assert result(trie.nodes(sequences, 100)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_many_heads_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARED_HEADS", 0)
    monkeypatch.setattr(trie, "CHUNK", 10)
    rows = [r for r in cases() if r[0] is not None and (r[0] < 30 or r[0] >= 1000)]
    assert result(trie.build(spark.createDataFrame(rows, COLUMNS), capacity=20)) == plain(rows)


def test_sweep_sums():
    got = trie.sweep([["a", "b"], ["a"], ["a", "c"], ["a", "b"]], [7, 9, 3, 5], [[2, 10], [2], [2, 5], [2, 10]], 4, 1)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(got) == [(3, 4, 1, 4, 2, 2, 16, sha("9")), (3, 5, 3, 1, 0, 1, 0, sha("3")), (5, 5, 3, 2, 0, 1, 10, sha("5,7"))]


def test_empty_and_turnless(spark):
    assert trie.build(spark.createDataFrame([], COLUMNS)).count() == 0
    rows = [(c, 1, "user", "one", "k", 1) for c in range(21, 40)]  # conversation 20 is absent
    got = result(trie.build(spark.createDataFrame(rows, COLUMNS)))
    assert got == plain(rows) and any(zlib.crc32(str(c).encode()) % 4 for c in range(21, 40))
