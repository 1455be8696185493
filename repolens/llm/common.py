"""Helpers that the operators share: table scans, the checkpoint folder, word splitting."""

from __future__ import annotations

import tempfile
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.sources.tables import table_path


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan one table, pruned to ``columns`` (all when none are named)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="repolens-llm-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder of the session.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    local session without that setting gets a scratch folder; a cluster without
    it is an error, since executors could not read each other's files.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def short_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Arrow batches hold ``rows`` rows at most: batches of the default 10,000 long texts take a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def ascii_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; bytes of UTF-8, so other letters stay."""
    return text.lower().split() if text else []


def word_counts(texts: DataFrame, limit: int = 200_000) -> DataFrame:
    """(word, c) over all texts (one binary column): counted per task in tables of ``limit`` words, then summed."""
    def counted(batches):
        counts: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(ascii_words(text.as_py()))
                if len(counts) >= limit:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()

    return texts.mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def commonest(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words whose count is in the upper classes (eight to a doubling) that hold ``most`` words at most, commonest first."""
    size = F.floor(F.log2("c") * 8)
    classes = sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True)
    least, held = None, 0
    for r in classes:
        held += r["count"]
        if held > most:
            break
        least = r["size"]
    rows = counts.where(size >= least).collect() if least is not None else []
    return sorted(((bytes(r.word), r.c) for r in rows), key=lambda x: (-x[1], x[0]))


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ... and the new name of each: no column of the caller can clash with an operator's own."""
    new = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*new), dict(zip(df.columns, new))


def restored(df: DataFrame, names: dict[str, str], *added: str) -> DataFrame:
    """The caller's columns under their names, and the added ones; a caller's column named like an added one gets ``_input`` behind it."""
    taken = {a.lower() for a in added}
    return df.select(*[F.col(c).alias(f"{n}_input" if n.lower() in taken else n) for n, c in names.items()], *added)


def hash_sample(df: DataFrame, h: str, limit: int) -> DataFrame:
    """At most ``limit`` rows in the order of a 64-bit hash column; a first cut by the count keeps what is sorted small."""
    share = min(1.0, 2 * limit / max(1, df.count()))
    cut = min(2**63 - 1, int(-2**63 + share * 2**64))
    return df.where(F.col(h) <= cut).orderBy(h).limit(limit)
