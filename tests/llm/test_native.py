"""Sharding and mixing: laws, reproducibility, edge rows and no Python in the plan."""

import math
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from repolens.llm import mixing, queries, sharding

from ..conftest import SMALL
from .helpers import DOCS, edge_docs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def placed(df, shards=4):
    rows = sharding.shard(df, shards).collect()
    assert sorted(r.row_no for r in rows) == sorted(r.position for r in rows) == list(range(len(rows)))
    sizes = Counter(r["shard"] for r in rows)
    assert not rows or max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(sizes[s]))
    return rows


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 17, 1000])
def test_permutation_of_every_size(spark, n):
    rows = placed(spark.range(n).toDF("doc_id"))
    assert len(rows) == n


def plain_position(x, n, seed=20240501):
    """The permutation in plain Python: rounds on the two digits of a number in base b, again while it lies outside."""
    def h(i, v):
        out = 42
        for packed in (struct.pack("<q", seed), struct.pack("<i", i), struct.pack("<q", v)):
            out = xxhash.xxh64_intdigest(packed, out)
        return out - 2**64 if out >= 2**63 else out

    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for i in range(1, sharding.ROUNDS + 1):
            if i % 2:
                left = (left + h(i, right) % a) % a
            else:
                right = (right + h(i, left) % b) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 7, 150, 1000])
def test_positions_against_a_plain_permutation(spark, n):
    for r in placed(spark.range(n).toDF("doc_id"), 8):
        assert r.position == plain_position(r.row_no, n) and (r["shard"], r.slot) == (r.position % 8, r.position // 8)


def test_reproducible_whatever_the_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    one = {r.doc_id: r.position for r in placed(docs)}
    assert one == {r.doc_id: r.position for r in placed(docs.repartition(7))}
    moved = sum(abs(a - b) for a, b in one.items())
    assert moved > len(one) * len(one) / 6  # a shuffle, not the order of ids


def test_edge_rows_keep_columns_and_copies(spark):
    docs = edge_docs(spark)
    out = sharding.shard(docs, 3)
    assert "shard_input" in out.columns and out.count() == docs.count()
    back = out.select(*[F.col(f"{c}_input" if c in ("shard",) else c).alias(c) for c in docs.columns])
    assert back.exceptAll(docs).count() == docs.exceptAll(back).count() == 0
    assert sharding.shard(edge_docs(spark, []), 3).count() == 0


def test_hot_row_is_numbered_without_a_hot_task(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"))
    assert len(placed(docs, 8)) == 3000


def test_query_is_native_and_whole(spark):
    out = queries.op5_sharding(spark, SMALL)
    assert "Python" not in plan(out) and "Arrow" not in plan(out)
    assert out.count() == 200 and {r.law for r in out.select("law").distinct().collect()} == {"rows"}


def poisson(mean, u):
    p = c = math.exp(-mean)
    k = 0
    while c <= u and k < 97:
        k += 1
        p *= mean / k
        c += p
    return k


def test_mix_inverts_the_distribution(spark):
    import hashlib

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = mixing.mix(docs).collect()
    rate = {r.doc_id: r.mix_rate for r in rows}
    copies = Counter(r.doc_id for r in rows)
    for d in docs.collect():
        if d.doc_id in rate and rate[d.doc_id] <= 16:
            key = f"7:{d.doc_id}:{hashlib.md5(d.text.encode()).hexdigest()}:1"
            u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
            assert copies[d.doc_id] == poisson(rate[d.doc_id], u)
    keys = [r.mix_key for r in mixing.mix(docs).select("mix_key").collect()]
    assert keys == sorted(keys)


def test_mix_meets_weights_on_average(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"),
                                     F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("source"))
    n = {r.source: r["count"] for r in mixing.mix(docs, weights={"rare": 3, "hot": 1}).groupBy("source").count().collect()}
    assert abs(n["rare"] - 15000) < 600 and abs(n["hot"] - 5000) < 400
    only = mixing.mix(docs, weights={"rare": 1}).select("source").distinct().collect()
    assert [r.source for r in only] == ["rare"]


def test_large_rates_are_split(spark):
    docs = spark.createDataFrame([(i, "x", "one") for i in range(5)] + [(9, "y" * 20000, "big")], "doc_id long, text string, source string")
    n = mixing.mix(docs).where("source = 'one'").count()
    assert 4700 < n < 5300  # a rate of 1000.55 each


def test_mix_edge_rows(spark, monkeypatch):
    docs = edge_docs(spark)
    out = mixing.mix(docs)
    assert "mix_key_input" in out.columns and mixing.mix(docs, added=False).columns == docs.columns
    few = sorted(map(str, out.select("doc_id", "mix_copy").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert few == sorted(map(str, mixing.mix(docs).select("doc_id", "mix_copy").collect()))
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_mix_is_native(spark):
    out = queries.op8_mixing(spark, SMALL)
    assert "Python" not in plan(out) and "Arrow" not in plan(out)
