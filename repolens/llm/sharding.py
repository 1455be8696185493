"""Reproducible sharding: a Feistel permutation over global row numbers.

Rows get a global number (their rank by a 64-bit row hash), the number is
permuted within ``0 .. n-1`` and the permuted position gives shard and slot:
``shard = position % shards``, ``slot = position div shards``. Shard sizes are
therefore at most one apart, slots are gapless, and both can be computed for
any row number without reading the data.

Everything is DataFrame and SQL functions. Equal rows are first counted (with
map-side combine), so a row that makes up a third of the table is one row until
it is exploded at the end; numbering works on hash ranges, never on one
partition of all rows.

Null columns take part in the row hash as nulls, empty and very long texts are
ordinary values, repeated rows get one position each, an empty table gives an
empty result, and columns of the caller named like ours come back as ``<name>_input``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import positional, restored

#: Hash ranges in which ranks are taken; bounds the table of offsets.
RANGES_BITS = 12
#: Feistel rounds; odd rounds move the left half, even rounds the right one.
ROUNDS = 8
#: Cycle walking leaves the domain with probability < 1/sqrt(n) a step.
WALKS = 64

ADDED = ("row_no", "position", "shard", "slot")


def feistel_sql(x: str, a: str, b: str, seed: int, rounds: int = ROUNDS) -> str:
    """SQL of a bijection on ``0 .. a*b-1``: alternating modular Feistel rounds."""
    return (
        f"aggregate(sequence(1, {rounds}), named_struct('l', ({x}) div {b}, 'r', ({x}) % {b}), (s, i) -> if(i % 2 = 1, "
        f"named_struct('l', (s.l + pmod(xxhash64({seed}L, i, s.r), {a})) % {a}, 'r', s.r), "
        f"named_struct('l', s.l, 'r', (s.r + pmod(xxhash64({seed}L, i, s.l), {b})) % {b})), s -> s.l * {b} + s.r)"
    )


def permuted_sql(x: str, n: str, seed: int) -> str:
    """SQL of a permutation of ``0 .. n-1``: the Feistel network on the next ``a * b >= n``, cycle-walked.

    ``a = ceil(sqrt(n))`` and ``b = ceil(n / a)``, so under ``a`` values lie outside and few rows walk.
    A walk always returns within ``a * b - n + 1`` steps; one that passed ``WALKS`` raises an error.
    """
    a, b = f"cast(ceil(sqrt({n})) as bigint)", f"cast(ceil({n} / ceil(sqrt({n}))) as bigint)"
    step = feistel_sql("walk", "w.a", "w.b", seed)
    walked = (f"aggregate(sequence(1, {WALKS}), cast({x} as bigint), (walk, i) -> if(i > 1 and walk < {n}, walk, {step}))")
    walked = walked.replace("w.a", a).replace("w.b", b)
    return f"transform(array({walked}), p -> if(p < {n}, p, raise_error('cycle walk too long')))[0]"


def shard(df: DataFrame, shards: int, seed: int = 20240501) -> DataFrame:
    """All rows of ``df`` with ``row_no``, ``position``, ``shard`` and ``slot``."""
    rows, names = positional(df)
    as_c = list(names.values())
    rows = rows.groupBy(*as_c).agg(F.count("*").alias("copies"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), *as_c))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - RANGES_BITS))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("bucket").agg(F.sum("copies").alias("rows_in"))
        .select("bucket", F.coalesce(F.sum("rows_in").over(before), F.lit(0)).alias("start"),
                F.sum("rows_in").over(Window.partitionBy()).alias("n"))
    )  # at most 2 ** RANGES_BITS rows
    upto = Window.partitionBy("bucket").orderBy("h", *as_c).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (
        rows.withColumn("upto", F.sum("copies").over(upto))
        .join(F.broadcast(offsets), "bucket")
        .withColumn("row_no", F.expr("explode(sequence(start + upto - copies, start + upto - 1))"))
    )
    placed = numbered.withColumn("position", F.expr(permuted_sql("row_no", "n", seed)))
    placed = placed.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn("slot", F.expr(f"position div {shards}"))
    return restored(placed, names, *ADDED)
