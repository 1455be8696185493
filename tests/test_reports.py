"""Whole reports: sections, modes, Markdown and both sinks."""

import json

import pytest

from repolens.operators import report as RP
from repolens.plans import queries as Q

from .conftest import SMALL


@pytest.fixture(scope="module")
def report(spark):
    from repolens.session import configure

    return Q._report(configure(spark), SMALL).persist()


def test_every_section_is_there(report):
    doc = json.loads(RP.report_json(RP.for_mode(report, "codebase")).where("repo_id = 0").first().report_json)
    assert {"stack", "stats", "architecture", "rules", "merged", "mode", "analyzed_at"} <= set(doc)
    assert {"files_by_extension", "secrets", "complexity", "file_count"} <= set(doc["stats"])
    assert sum(doc["stats"]["files_by_extension"].values()) == doc["stats"]["file_count"]
    assert doc["stats"]["secrets"]["files_scanned"] > 0
    assert {f["type"] for f in doc["stats"]["secrets"]["findings"]} >= {"AWS Access Key", "OpenAI API Key"}


def test_modes_hold_their_ai_sections(report):
    rows = {((r.repo_id, r.scan_id), r.mode): json.loads(r.report_json) for r in RP.report_json(RP.all_modes(report)).collect()}
    assert {m for _, m in rows} == set(RP.MODES)
    assert any("security" in doc for doc in rows.values())
    for (repo, mode), doc in rows.items():
        assert {s for s in ("security", "deployment") if s in doc} == {s for s in RP.MODES[mode] if s in rows[(repo, "codebase")]}
    for (repo, mode), doc in rows.items():  # all else is the same in every mode
        base = rows[(repo, "stack")]
        assert {k: v for k, v in doc.items() if k not in ("security", "deployment", "mode")} == {k: v for k, v in base.items() if k != "mode"}


def test_markdown_follows_the_report(report):
    docs = {(r.repo_id, r.scan_id): json.loads(r.report_json) for r in RP.report_json(RP.for_mode(report, "codebase")).collect()}
    for r in RP.report_markdown(RP.for_mode(report, "codebase")).collect():
        doc, text = docs[r.repo_id, r.scan_id], r.markdown
        assert f"> Generated at {doc['analyzed_at']}" in text and f"| Files | {doc['stats']['file_count']} |" in text
        found = doc["stats"]["secrets"]["findings"]
        assert ("## Secrets Found" in text) == bool(found)
        assert text.count("(critical) — `") + text.count("(high) — `") + text.count("(medium) — `") == min(20, len(found))
        assert (f"- ... and {len(found) - 20} more" in text) == (len(found) > 20)
        assert ("## Stack Scores" in text) == ("reasoning" in doc)
        assert ("## Security Analysis" in text) == ("security" in doc) and ("## Deployment Analysis" in text) == ("deployment" in doc)
        vulns = doc["stats"].get("vulnerabilities")
        assert ("## Dependency Vulnerabilities" in text) == bool(vulns and vulns["total"])
        assert text.count("\n### ") >= len(doc["merged"]) and ("**High complexity files:**" in text) == bool(doc["stats"]["complexity"]["high_complexity_files"])


def test_sinks_write_every_report(spark, report, tmp_path):
    n = report.count()
    RP.write_report_json(RP.for_mode(report, "codebase"), str(tmp_path / "json"))
    back = spark.read.json(str(tmp_path / "json"))
    assert back.count() == n and json.loads(back.first().report_json)["mode"] == "codebase"
    RP.write_report_markdown(RP.report_markdown(RP.for_mode(report, "stack")), str(tmp_path / "md"))
    lines = spark.read.text(str(tmp_path / "md"))
    assert lines.where("value like '<!-- repo %'").count() == n


def test_audits_of_given_repositories_and_odd_names(spark, tmp_path):
    """Reports of the audited repositories alone; names keep their characters through the JSON text."""
    import json

    from repolens.operators import audit as AU

    names = ['plain', 'quo"te', 'back\\slash', 'line\nend', 'umlaut \u00e4 \u2028', None]
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(order, part, line, "RAN"[(order + line) % 3]) for order in range(1, 30) for line, part in enumerate(range(6))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = {r.repo_id: r.audit_json for r in AU.derive_audit_reports(spark, str(tmp_path)).collect()}
    assert len(whole) == 29
    for order, text in whole.items():
        if order % AU.BROKEN_EVERY:
            report = json.loads(text)
            if "vulnerabilities" in report:
                assert list(report["vulnerabilities"]) == [f"{n}#{k}" for k, n in enumerate(names, 1) if n is not None]
                assert report["vulnerabilities"]["plain#1"]["severity"] == "critical"
            if "advisories" in report:
                assert [a.get("module_name") for a in report["advisories"].values()] == names
    audited = spark.createDataFrame([(3,), (5,), (7,), (22,), (400,)], "repo_id long")
    some = {r.repo_id: r.audit_json for r in AU.derive_audit_reports(spark, str(tmp_path), audited).collect()}
    assert some == {k: whole[k] for k in (3, 5, 7, 22)}
    plan = AU.derive_audit_reports(spark, str(tmp_path), audited)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") > plan.index("Window")  # before anything is derived


def test_responses_are_turned_into_records_slice_by_slice():
    import pyarrow as pa

    from repolens.operators import ai as AI

    class Batch:
        def __init__(self, texts):
            self.texts, self.asked = texts, []

        def __len__(self):
            return len(self.texts)

        def slice(self, at, n):
            self.asked.append(n)
            return self.texts.slice(at, n)

    texts = pa.array([None if i % 7 == 0 else '{"summary": "s%d", "score": %d}' % (i, i % 10) for i in range(1000)])
    batch = Batch(texts)
    got = AI.records("security", batch)
    assert max(batch.asked) <= 128 and len(got) == 1000
    assert got.to_pylist() == pa.array([AI.NO.record("security", t) for t in texts.to_pylist()], got.type).to_pylist()
    assert len(AI.records("reasoning", pa.array([], pa.string()))) == 0
