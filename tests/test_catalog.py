"""Long-form detection against the wide profile, with a user's own catalogue; quarantine sinks."""

import json

import pytest
from pyspark.sql import functions as F

from repolens.operators import ai as AI
from repolens.operators import catalog as CAT
from repolens.operators import files as FF
from repolens.operators import profile as PR
from repolens.operators import secrets as SC
from repolens.sources import quarantine as QN

from .test_literals import files_df, pkg


def manifests():
    names = [r[3] for r in CAT.node_catalog_rows()]
    repos = {i: {"package.json": pkg({names[i % len(names)]: "1", names[(7 * i) % len(names)]: "1"}, {names[(5 * i + 2) % len(names)]: "1"})} for i in range(40)}
    return repos | {50: {"package.json": pkg({"next": "1", "react": "1"})}, 51: {"package.json": "{broken"}, 52: {"package.json": pkg({"prisma": "1"})},
                    53: {"package.json": pkg(dev={"prisma": "1"})}, 54: {"lib/package.json": pkg({"react": "1"})}}


def test_long_form_equals_the_profile(spark):
    files = files_df(spark, manifests())
    got = {}
    for r in CAT.detect(CAT.manifest_dependencies(files), CAT.node_catalog(spark)).orderBy("ord").collect():
        got.setdefault((r.repo_id, r.facet), []).append(r.label)
    for p in PR.repo_profile(FF.file_facts(files)).collect():
        for facet in ("frontend", "backend", "databases", "testing", "build_tools"):
            assert got.get((p.repo_id, facet), []) == p[facet], (p.repo_id, facet)


def test_a_large_catalogue_is_joined_by_shuffle(spark):
    deps = CAT.manifest_dependencies(files_df(spark, manifests()))
    own = CAT.node_catalog(spark).unionByName(spark.createDataFrame([(99, "backend", "Own", "next", False, None)], CAT.CATALOG))
    few, many = CAT.detect(deps, own), CAT.detect(deps, own, small=5)
    assert "BroadcastExchange" in few._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert few.where("repo_id = 50 and label in ('Own', 'Next.js', 'React')").count() == 2


def test_quarantine_of_responses_and_targets(spark, tmp_path):
    env = lambda c: json.dumps({"choices": [{"message": {"content": c}}]})
    rows = [(1, "1-0", "analysis", env("{}")), (2, "2-0", "analysis", env(" ")), (9, "9-0", "analysis", env("{}")), (1, "1-1", "security", "no json")]
    responses = spark.createDataFrame(rows, "repo_id long, scan_id string, kind string, response string")
    scanned = AI.scan_ai_responses(responses, spark.createDataFrame([(1,), (2,)], "repo_id long"))
    plain = scanned.withColumnRenamed("reject_reason", "why")
    assert QN.quarantine(plain, F.col("why"), str(tmp_path / "ai")) == {"accepted": 1, "rejected": 3}
    back = QN.read(spark, str(tmp_path / "ai"), QN.REJECTED, plain.schema)
    assert {(r.repo_id, r.reject_reason) for r in back.collect()} == {(1, "no_choices"), (2, "empty_content"), (9, "unknown_repository")}
    targets = spark.createDataFrame([("https://github.com/a/b",), ("../x",), (None,)], "target string")
    assert QN.quarantine(targets, SC.target_verdict(F.col("target")), str(tmp_path / "t")) == {"accepted": 1, "rejected": 2}
    assert QN.quarantine(targets.limit(0), SC.target_verdict(F.col("target")), str(tmp_path / "none")) == {"accepted": 0, "rejected": 0}


def test_sinks_that_do_not_add_up_are_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(QN, "read", lambda spark, *a: spark.range(1))
    with pytest.raises(RuntimeError, match="written"):
        QN.quarantine(spark.range(5), F.when(F.col("id") > 3, F.lit("big")), str(tmp_path / "x"))
