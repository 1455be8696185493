"""The pipeline: every stage against a plain version on its own input, whole run, edge rows."""

from collections import Counter

import corpus_pipeline as cp
from repolens.llm import mixing

from ..conftest import SMALL
from .helpers import edge_docs, tables
from .test_decontamination import brute as brute_hits
from .test_jaccard import brute as brute_links


def test_stages_against_plain_versions(spark, tmp_path):
    folder = SMALL.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    held = {0: docs}
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, held[i], folder).write.parquet(str(tmp_path / str(i)))
        held[i + 1] = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert held[i + 1].columns == names
    rows = {i: df.collect() for i, df in held.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id for r in rows[1]}
    assert sum(labels[d] == (d in kept) for d in labels) > 0.97 * len(labels)

    before = sorted(rows[1], key=lambda r: r.doc_id)
    _, comp = brute_links([r.text for r in before], 5, 80, 100)
    assert sorted(r.doc_id for r in rows[2]) == sorted({before[c].doc_id for c in comp})

    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in rows[2]], bench)
    assert sorted(r.doc_id for r in rows[3]) == sorted(h[0] for h in hits if not h[5])

    mixed = Counter(r.doc_id for r in mixing.mix(held[3]).collect())
    assert Counter(r.doc_id for r in rows[4]) == mixed
    assert Counter(r.doc_id for r in rows[5]) == mixed
    sizes = Counter(r["shard"] for r in rows[5])
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_run_on_edge_rows(spark, tmp_path):
    labels = spark.createDataFrame([(0, 1, 0), (8, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, None)], "item_id long, text string")
    folder = tables(spark, tmp_path / "a", documents=edge_docs(spark), labels=labels, benchmark=bench)
    out = cp.run(spark, folder)
    assert {"doc_id", "shard", "slot", "shard_input"} <= set(out.columns) and out.where("doc_id = 13").count() == 0
    empty = tables(spark, tmp_path / "b", documents=edge_docs(spark, []), labels=labels.where("false"), benchmark=bench.where("false"))
    assert cp.run(spark, empty).count() == 0
