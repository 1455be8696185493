"""Plan checks: what crosses a shuffle, what is broadcast, what reaches the scan."""

from repolens.operators import files as FF
from repolens.operators import profile as PR

from .conftest import SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_is_one_scan_and_keeps_content_out_of_shuffles(spark):
    prof = PR.repo_profile(FF.corpus_facts(spark, SMALL))
    plan = _plan(prof)
    assert plan.count("FileScan parquet") == 1
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "content" not in line and "text#" not in line
    assert "SortAggregate" not in plan                     # hash-based aggregation only
    assert "BroadcastHashJoin" in plan                     # fixed 150-row slot table


def test_scan_reads_only_needed_columns(spark):
    from repolens.sources import request_log as RL
    plan = _plan(RL.request_log(spark, SMALL).select("event_id", "sec"))
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln][0]
    assert "value" not in scan and "props" not in scan


def test_top_n_is_limited_before_the_shuffle(spark):
    from repolens.operators import complexity as CX
    df = CX.high_complexity_files(FF.corpus_facts(spark, SMALL))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_no_query_deals_rows_round_robin(spark):
    import __spark_entry__ as entry

    queries = entry.queries()
    for name in ("repo_stats", "scan_secrets", "mask_tokens", "stack_profile", "request_gate", "quota_usage", "validate_targets", "normalize_scores"):
        plan = _plan(queries[name](spark, SMALL))
        assert "RoundRobin" not in plan, name
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_all_text_reaches_the_corpus(spark):
    from repolens.sources import corpus

    free = {path for _, _, path, _, append in corpus.slot_rows() if not append}
    assert free <= {"package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "requirements.txt", "pyproject.toml", "go.mod", "Cargo.toml"}


def test_request_gate_reads_the_log_twice(spark, monkeypatch):
    from repolens.operators import quota as QU
    from repolens.sources import request_log as RL

    plans = []
    whole = QU.checkpointed
    monkeypatch.setattr(QU, "checkpointed", lambda df: plans.append(_plan(df)) or whole(df))
    log, tokens = RL.request_log(spark, SMALL), spark.createDataFrame([("t", "any")], "token string, state string")
    final = _plan(QU.request_gate(log, tokens))
    assert plans[0].count("FileScan parquet") == 2 and "FileScan" not in final
    assert final.count("Exchange hashpartitioning") <= 6
    for name in ("user_agent", "auth_header", "signature", "client_ts"):
        assert name not in final


def test_reports_read_the_documents_twice_and_the_profile_without_an_exchange(spark, monkeypatch):
    from repolens.operators import store as STORE
    from repolens.plans import queries as Q
    from repolens.session import configure

    plans, whole = [], STORE.checkpointed
    monkeypatch.setattr(STORE, "checkpointed", lambda df: plans.append(_plan(df)) or whole(df))
    report = _plan(Q._report(configure(spark), SMALL))
    scans = lambda plan: [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "documents.parquet" in ln]
    assert [len(scans(p)) for p in plans] == [1, 1] and not scans(report)
    assert len(report) < 100_000 and "Bucketed: true" in report

    store = STORE.persist(Q.repo_files(spark, SMALL), buckets=4)
    own = store.profile.select("repo_id", "file_count")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = _plan(own.join(store.profile.select("repo_id", "project_type"), "repo_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in joined and "SortMergeJoin" in joined
