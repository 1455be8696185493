"""Mixing sources to target weights by Poisson replication.

Each source has a target repetition rate: the size it should have under its
target weight, divided by the size it has. A document's number of copies is a
Poisson variate with that mean, found by inverting the distribution at a
uniform number hashed from seed, document id and text. Documents are exploded by their
count and shuffled globally by a second hash.

Everything is DataFrame and SQL functions. Rates are one small row a source;
they are broadcast when at most ``BROADCAST_SOURCES`` sources exist and joined
on (source, salt) beyond it, so a hot source is never one task.

A null source is a source of its own; null and empty texts count one byte, as
the size of every text is its bytes plus one. Equal rows get equal counts.
Sources without a target weight get rate 0; without any weights all sources
weigh the same. An empty table gives an empty result. Columns of the caller
named like the added ones come back as ``<name>_input``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positional, restored, saved

#: A Poisson mean above this is split into equal independent parts of at most this mean.
PART_MEAN = 16
#: Terms of the distribution function; beyond them lies less than 2 ** -52 for a mean of PART_MEAN.
TERMS = 96
BROADCAST_SOURCES = 20_000
SALTS = 32
ADDED = ("mix_rate", "mix_copies", "mix_copy", "mix_key")


def rates(df: DataFrame, source: str, text: str, weights: dict | None = None, total: float = 1.0) -> DataFrame:
    """(source, size, rate, parts, cdf) of each source: ``rate = weight share * total size * total / own size``."""
    sizes = df.groupBy(F.col(source).alias("source")).agg(
        F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        weighed = sizes.withColumn("weight", F.coalesce(
            *[F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))) for k, w in weights.items()], F.lit(0.0)))
    sums = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))  # one row
    rated = weighed.join(F.broadcast(sums), F.lit(True)).withColumn(
        "rate", F.expr(f"weight * (all_size * {float(total)!r}D) / (all_weight * size)"))
    return rated.select(
        "source", "size", "rate", F.expr(f"cast(greatest(1, ceil(rate / {PART_MEAN})) as int)").alias("parts"),
    ).withColumn("mean", F.expr("rate / parts")).withColumn("cdf", F.expr(
        f"aggregate(sequence(1, {TERMS}), named_struct('p', exp(-mean), 'c', array(exp(-mean))), (s, i) -> named_struct("
        "'p', s.p * mean / i, 'c', array_append(s.c, element_at(s.c, -1) + s.p * mean / i)), s -> s.c)"))


def uniform_sql(*parts: str) -> str:
    """SQL of a number in [0, 1) with 52 bits from the MD5 of the parts joined by ``:``."""
    return f"conv(substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13), 16, 10) / 4503599627370496D"


def mix(df: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text",
        weights: dict | None = None, total: float = 1.0, seed: int = 7, added: bool = True) -> DataFrame:
    """Rows of ``df`` repeated by their count, in the order of ``mix_key``.

    Adds ``mix_rate``, ``mix_copies`` (the document's count), ``mix_copy`` (from 1) and ``mix_key``, unless ``added`` is false.
    """
    table = saved(rates(df, source, text, weights, total)).select("source", F.col("rate").alias("mix_rate"), "parts", "cdf")
    rows, names = positional(df)
    s, d, t = names[source], names[doc_id], names[text]
    rows = rows.withColumn("id", F.concat_ws(":", F.coalesce(F.col(d).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(t), F.lit("")))))
    same = F.col(s).eqNullSafe(F.col("source"))
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(table), same)
    else:
        table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("of", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(table, same & (F.col("of") == F.col("salt")))
    u = uniform_sql(f"'{seed}'", "id", "cast(j as string)")  # hashed once a part, then compared with all terms
    counted = rows.withColumn("mix_copies", F.expr(
        f"aggregate(transform(sequence(1, parts), j -> {u}), 0L, (k, u) -> k + size(filter(cdf, c -> c <= u)))"))
    copies = counted.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.expr("sequence(1L, mix_copies)")))
    keyed = copies.withColumn("mix_key", F.expr(f"md5(concat_ws(':', '{seed}', 'order', id, cast(mix_copy as string)))"))
    keyed = keyed.select(*names.values(), *ADDED).orderBy("mix_key", d, "mix_copy")
    return restored(keyed, names, *(ADDED if added else ()))
