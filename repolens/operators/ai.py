"""AI batch tables (operators A3, E10, H1-H13) - requests out, responses in.

No network call is made. Request rows (prompt text, model, cache key) are
built per repository from the profile; recorded responses are a table that
is validated (A3), normalised with typed defaults (H7-H11), merged with the
rule findings (H12) and compared (H13). Every step works on
one repository's row - the per-repository arrays are bounded by the response
size - so there is no shuffle beyond the joins on ``repo_id``. Normalising is an
Arrow function that parses each response once; as column expressions it took
10 to 30 s of code generation a query and ran interpreted.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from repolens.functions.text import js_trim
from repolens.operators import normalise as NO
from repolens.sources.corpus import FILES_PER_REPO
from repolens.sources.tables import read_table

# ---------------------------------------------------------------------------
# Fixed values of the reference: summary layout, defaults and enums.
# ---------------------------------------------------------------------------
SUMMARY_DEPS, SUMMARY_DEV_DEPS = 30, 20
NONE_DETECTED = "None detected"
ANALYSIS_MODEL, REASONING_MODEL = "moonshotai/kimi-k2-instruct", "openai/gpt-oss-120b"
LEVELS, SCORE_DIMENSIONS = NO.LEVELS, NO.SCORE_DIMENSIONS
SECURITY_SEVERITIES, DEPLOY_PRIORITIES = NO.SECURITY_SEVERITIES, NO.DEPLOY_PRIORITIES
PRIORITY_ORDER = {"high": 0, "medium": 1, "low": 2}
NO_ANALYSIS = "No analysis available."
SLICE = 128
# ---------------------------------------------------------------------------


# ---- H1 / H2: summary text and cache keys -----------------------------------

def project_summary(profile: DataFrame) -> DataFrame:
    def listed(c):
        return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(F.lit(NONE_DETECTED))
    lines = [
        F.concat(F.lit("PROJECT TYPE: "), F.col("project_type")), F.lit(""),
        F.lit("FRONTEND"), listed("frontend"), F.lit(""),
        F.lit("BACKEND"), listed("backend"), F.lit(""),
        F.lit("DATABASE"), listed("databases"), F.lit(""),
        F.lit("STYLING"), listed("styling"), F.lit(""),
        F.lit("LANGUAGE"), F.col("language"), F.lit(""),
        F.lit("PACKAGE MANAGER"), F.coalesce(F.nullif("package_manager", F.lit("")), F.lit("Unknown")), F.lit(""),
        F.lit("API ROUTES"), F.col("api_route_count").cast("string"), F.lit(""),
        F.lit("COMPONENT COUNT"), F.col("component_count").cast("string"), F.lit(""),
        F.lit("FILE COUNT"), F.col("file_count").cast("string"), F.lit(""),
        F.lit("DEPENDENCIES"), F.array_join(F.slice("dependencies", 1, SUMMARY_DEPS), " "), F.lit(""),
        F.lit("DEV DEPENDENCIES"), F.array_join(F.slice("dev_dependencies", 1, SUMMARY_DEV_DEPS), " "),
    ]
    return profile.select("repo_id", F.concat_ws("\n", *lines).alias("summary"))


def summary_hash(summary: Column) -> Column:
    return F.substring(F.sha2(summary, 256), 1, 16)


def cache_key(kind: str, model: str, summary: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), F.lit(model), summary_hash(summary))


def cache_file_key(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 16)


# ---- H3-H6: request rows ---------------------------------------------------------

def _yes(c) -> Column:
    return F.when(c, F.lit("YES")).otherwise(F.lit("NO"))


def analysis_requests(profile: DataFrame, summaries: DataFrame, patterns: DataFrame) -> DataFrame:
    """H3: one analysis request per repository (header of detected facts + summary)."""
    df = profile.select("repo_id", "project_type", "has_typescript", "test_file_count") \
        .join(summaries, "repo_id").join(patterns, "repo_id", "left")
    header = F.concat_ws("\n",
                         F.lit("PROJECT CONTEXT (pre-detected):"),
                         F.concat(F.lit("- Project Type: "), F.col("project_type")),
                         F.concat(F.lit("- TypeScript Detected: "), _yes(F.col("has_typescript"))),
                         F.concat(F.lit("- Test Files Found: "), F.col("test_file_count").cast("string")),
                         F.concat(F.lit("- Architecture Patterns: "),
                                  F.coalesce(F.nullif("patterns", F.lit("")), F.lit("unknown"))))
    prompt = F.concat(header, F.lit("\n\nAnalyse this project summary and answer with JSON only:\n\n"), F.col("summary"))
    return df.select("repo_id", F.lit("analysis").alias("kind"), F.lit(ANALYSIS_MODEL).alias("model"),
                     cache_key("analysis", ANALYSIS_MODEL, F.col("summary")).alias("cache_key"),
                     prompt.alias("prompt"))


def reasoning_requests(profile: DataFrame, summaries: DataFrame, analysis_json: DataFrame,
                       rule_text: DataFrame) -> DataFrame:
    """H4: summary + analysis JSON (or a sentinel) + rule findings text + context notes, a request for every scan with an analysis (or one without).

    ``analysis_json`` has (repo_id, scan_id, analysis_json, project_context)."""
    df = (profile.select("repo_id", "project_type", "has_typescript", "test_file_count")
          .join(summaries, "repo_id").join(rule_text, "repo_id").join(analysis_json, "repo_id", "left"))
    notes = F.array_compact(F.array(
        F.concat(F.lit("PROJECT TYPE: "), F.col("project_type")),
        F.concat(F.lit("PROJECT CONTEXT: "), F.nullif("project_context", F.lit(""))),
        F.when(F.col("test_file_count") > 0,
               F.concat(F.lit("NOTE: "), F.col("test_file_count").cast("string"), F.lit(" test files exist.")))
         .otherwise(F.lit("NOTE: no test files and no test framework detected.")),
        F.when(F.col("has_typescript"), F.lit("NOTE: TypeScript is already in use."))
         .otherwise(F.lit("NOTE: TypeScript is not detected."))))
    prompt = F.concat_ws("\n",
                         F.lit("CONTEXT CONSTRAINTS:"), F.array_join(F.transform(notes, lambda n: F.concat(F.lit("- "), n)), "\n"),
                         F.lit(""), F.lit("PROJECT SUMMARY:"), F.col("summary"),
                         F.lit(""), F.lit("DEEP ANALYSIS:"), F.coalesce("analysis_json", F.lit(NO_ANALYSIS)),
                         F.lit(""), F.lit("RULE ENGINE FINDINGS:"), F.col("rule_text"))
    return df.select("repo_id", "scan_id", F.lit("reasoning").alias("kind"), F.lit(REASONING_MODEL).alias("model"),
                     cache_key("reasoning", REASONING_MODEL, F.col("summary")).alias("cache_key"),
                     prompt.alias("prompt"))


def security_requests(profile: DataFrame, summaries: DataFrame, audit: DataFrame, secret_counts: DataFrame,
                      top_files: DataFrame, non_http: Column) -> DataFrame:
    """H5: adds audit counts (or 'not scanned'), secret count, top-5 complex files, non-HTTP caveat."""
    df = (profile.select("repo_id", "project_type", "has_typescript", "has_docker", "has_ci", "test_file_count",
                         non_http.alias("non_http"))
          .join(summaries, "repo_id").join(audit, "repo_id", "left").join(secret_counts, "repo_id", "left")
          .join(top_files, "repo_id", "left"))
    vuln = F.when(F.col("total").isNull(), F.lit("- Dependency vulnerabilities: not scanned")).otherwise(
        F.format_string("- Dependency vulnerabilities: %d critical, %d high, %d moderate, %d low",
                        "critical", "high", "moderate", "low"))
    files = F.when(F.size(F.coalesce("top_files", F.array())) > 0,
                   F.concat(F.lit("- High complexity files: "), F.array_join(F.slice("top_files", 1, 5), ", "))
                   ).otherwise(F.lit("- High complexity files: none detected"))
    prompt = F.concat_ws("\n",
                         F.concat(F.lit("- Project Type: "), F.col("project_type")),
                         F.concat(F.lit("- TypeScript: "), _yes(F.col("has_typescript"))),
                         F.concat(F.lit("- Docker: "), _yes(F.col("has_docker"))),
                         F.concat(F.lit("- CI/CD: "), _yes(F.col("has_ci"))),
                         F.concat(F.lit("- Test Files Found: "), F.col("test_file_count").cast("string")),
                         F.when(F.col("non_http"), F.lit("THIS PROJECT DOES NOT SERVE HTTP TRAFFIC.")),
                         vuln,
                         F.concat(F.lit("- Secrets/credentials found: "),
                                  F.coalesce("secret_findings", F.lit(0)).cast("string"), F.lit(" findings")),
                         files, F.lit(""), F.col("summary"))
    return df.select("repo_id", F.lit("security").alias("kind"), F.lit(ANALYSIS_MODEL).alias("model"),
                     cache_key("security", ANALYSIS_MODEL, F.col("summary")).alias("cache_key"), prompt.alias("prompt"))


def deployment_requests(profile: DataFrame, summaries: DataFrame, non_http: Column) -> DataFrame:
    """H6: Docker / CI / file counts plus a non-server caveat."""
    df = profile.select("repo_id", "project_type", "has_docker", "has_ci", "file_count", "test_file_count",
                        non_http.alias("non_http")).join(summaries, "repo_id")
    prompt = F.concat_ws("\n",
                         F.concat(F.lit("- Project Type: "), F.col("project_type")),
                         F.concat(F.lit("- Docker: "), _yes(F.col("has_docker"))),
                         F.concat(F.lit("- CI/CD: "), _yes(F.col("has_ci"))),
                         F.concat(F.lit("- Files: "), F.col("file_count").cast("string")),
                         F.concat(F.lit("- Test Files Found: "), F.col("test_file_count").cast("string")),
                         F.when(F.col("non_http"), F.lit("THIS PROJECT IS NOT A SERVER.")),
                         F.lit(""), F.col("summary"))
    return df.select("repo_id", F.lit("deployment").alias("kind"), F.lit(ANALYSIS_MODEL).alias("model"),
                     cache_key("deployment", ANALYSIS_MODEL, F.col("summary")).alias("cache_key"), prompt.alias("prompt"))


# ---- A3: recorded responses ---------------------------------------------------------

def _vtype(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def scan_ai_responses(responses: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """A3: take ``choices[0].message.content``; reject no choices, blank, non-JSON, JSON null, and those of no repository in ``repos`` (if given).

    Returns every response with ``content`` and ``reject_reason`` (NULL when accepted).
    """
    env = F.try_parse_json("response")
    choices_ok = _vtype(env, "$.choices").startswith("ARRAY") & \
        (F.coalesce(F.size(F.try_variant_get(env, "$.choices", "array<variant>")), F.lit(0)) > 0)
    content_t = _vtype(env, "$.choices[0].message.content")
    content = F.when(content_t == "STRING", F.try_variant_get(env, "$.choices[0].message.content", "string"))
    parsed = F.try_parse_json(content)
    reason = (F.when(env.isNull() | ~choices_ok, F.lit("no_choices"))
              .when(content_t.isNotNull() & (content_t != "STRING") & (content_t != "VOID"), F.lit("bad_content"))
              .when(js_trim(F.coalesce(content, F.lit(""))) == "", F.lit("empty_content"))
              .when(parsed.isNull(), F.lit("non_json"))
              .when(F.schema_of_variant(parsed) == "VOID", F.lit("null_json")))
    if repos is not None:
        responses = responses.join(repos.select("repo_id", F.lit(True).alias("held")), "repo_id", "left")
        reason = F.coalesce(reason, F.when(F.col("held").isNull(), F.lit("unknown_repository")))
    return responses.select("repo_id", "scan_id", "kind", content.alias("content"), reason.alias("reject_reason"))


# ---- H7-H11: normalisers ------------------------------------------------------------

def records(kind: str, contents: pa.Array) -> pa.Array:
    """The records of a batch, of which a slice at a time is in Python objects."""
    arrow = NO.KINDS[kind][1]
    parts = [pa.array([NO.record(kind, c) for c in contents.slice(i, SLICE).to_pylist()], arrow) for i in range(0, len(contents), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], arrow)


def _normaliser(kind: str):
    """A column function from a response's JSON text to its record: one parse, Arrow batches (``operators/normalise.py``)."""
    def normalised(content: Column) -> Column:
        @arrow_udf(NO.ddl(NO.KINDS[kind][1]))
        def parsed(contents: pa.Array) -> pa.Array:
            return records(kind, contents)

        return parsed(content)
    return normalised


normalize_analysis = _normaliser("analysis")        # H7
normalize_reasoning = _normaliser("reasoning")      # H8 + H9
normalize_security = _normaliser("security")        # H10
normalize_deployment = _normaliser("deployment")    # H11


def severity_counts(items: Column, field: str, levels) -> list[Column]:
    """Count of ``items`` per level of ``field``."""
    def eq(level):
        return lambda x: x[field] == level
    return [F.size(F.filter(items, eq(lv))).cast("bigint").alias(f"{field}_{lv}") for lv in levels]


# ---- H12 / H13 -------------------------------------------------------------------------

def _norm(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


MERGED_FIELDS = ["id", "source", "category", "current", "suggested", "reason", "benefit", "tradeoffs",
                 "alternatives", "migrationNotes", "priority", "effort", "severity", "tags", "evidence"]


def merge_suggestions(findings: Column, suggestions: Column) -> Column:
    """Rules first, AI items deduplicated against the items kept so far, stable priority sort.

    An AI item is dropped when its normalised category equals, or its
    (current, suggested) pair equals, that of any kept item; on a category
    match every kept item of that category becomes ``both``. A category can be
    kept by at most one AI item and every later item of it is a duplicate, so
    "marked" is a property of the category key: the fold only carries keys
    (kept categories, kept pairs, kept AI positions, marked categories) over
    one repository's AI suggestions, and the merged list is assembled after it.
    """
    empty = F.array().cast("array<string>")
    sug = F.coalesce(suggestions, F.array().cast(
        "array<struct<category:string,current:string,suggested:string,reason:string,benefit:string,"
        "tradeoffs:string,alternatives:string,migrationNotes:string,priority:string,effort:string>>"))
    rule_cats = F.transform(findings, lambda f: _norm(f["category"]))
    rule_pairs = F.transform(findings, lambda f: F.concat_ws("\u0000", _norm(f["current"]), _norm(f["suggested"])))
    init = F.struct(rule_cats.alias("cats"), rule_pairs.alias("pairs"), F.array().cast("array<int>").alias("kept"),
                    empty.alias("marked"))
    indexed = F.transform(sug, lambda s, i: F.struct(
        (i + 1).alias("idx"), _norm(s["category"]).alias("cat"),
        F.concat_ws("\u0000", _norm(s["current"]), _norm(s["suggested"])).alias("pair")))

    def step(acc, x):
        cat_dup = F.array_contains(acc["cats"], x["cat"])
        dup = cat_dup | F.array_contains(acc["pairs"], x["pair"])
        return F.when(dup, F.struct(acc["cats"].alias("cats"), acc["pairs"].alias("pairs"), acc["kept"].alias("kept"),
                                    F.when(cat_dup, F.array_union(acc["marked"], F.array(x["cat"])))
                                    .otherwise(acc["marked"]).alias("marked"))) \
            .otherwise(F.struct(F.concat(acc["cats"], F.array(x["cat"])).alias("cats"),
                                F.concat(acc["pairs"], F.array(x["pair"])).alias("pairs"),
                                F.concat(acc["kept"], F.array(x["idx"])).alias("kept"), acc["marked"].alias("marked")))

    def merged(state):
        null_s, null_arr = F.lit(None).cast("string"), F.lit(None).cast("array<string>")

        def source(cat, own):
            return F.when(F.array_contains(state["marked"], _norm(cat)), F.lit("both")).otherwise(F.lit(own))

        rules = F.transform(findings, lambda f: F.struct(
            f["rule_id"].alias("id"), source(f["category"], "rule").alias("source"), f["category"].alias("category"),
            f["current"].alias("current"), f["suggested"].alias("suggested"), f["reason"].alias("reason"),
            f["benefit"].alias("benefit"), null_s.alias("tradeoffs"), null_s.alias("alternatives"),
            null_s.alias("migrationNotes"), f["priority"].alias("priority"), f["effort"].alias("effort"),
            f["severity"].alias("severity"), f["tags"].alias("tags"), f["evidence"].alias("evidence")))
        with_idx = F.transform(sug, lambda s, i: F.struct((i + 1).alias("idx"), s.alias("s")))
        kept = F.filter(with_idx, lambda x: F.array_contains(state["kept"], x["idx"]))
        ai = F.transform(kept, lambda x: F.struct(
            F.concat(F.lit("AI_"), F.when(x["idx"] < 1000, F.lpad(x["idx"].cast("string"), 3, "0")).otherwise(x["idx"].cast("string"))).alias("id"),
            source(x["s"]["category"], "ai").alias("source"), x["s"]["category"].alias("category"),
            x["s"]["current"].alias("current"), x["s"]["suggested"].alias("suggested"), x["s"]["reason"].alias("reason"),
            x["s"]["benefit"].alias("benefit"), x["s"]["tradeoffs"].alias("tradeoffs"),
            x["s"]["alternatives"].alias("alternatives"), x["s"]["migrationNotes"].alias("migrationNotes"),
            x["s"]["priority"].alias("priority"), x["s"]["effort"].alias("effort"), null_s.alias("severity"),
            null_arr.alias("tags"), null_arr.alias("evidence")))
        both = F.concat(rules, ai)
        prio = F.create_map(*[x for k, v in PRIORITY_ORDER.items() for x in (F.lit(k), F.lit(v))])
        keyed = F.transform(both, lambda m, i: F.struct(prio[m["priority"]].alias("p"), i.alias("seq"), m.alias("m")))
        return F.transform(F.array_sort(keyed), lambda k: k["m"])

    # the fold's state is bound once, as the variable of an outer transform
    return F.element_at(F.transform(F.array(F.aggregate(indexed, init, step)), merged), 1)


def score_delta(reasoning: Column) -> Column:
    """Per dimension current, optimized, difference and band of the current score."""
    cur, opt = reasoning["scores"]["current"], reasoning["scores"]["optimized"]
    return F.array(*[F.struct(F.lit(d).alias("dimension"), cur[d].alias("current"), opt[d].alias("optimized"),
                              (opt[d] - cur[d]).alias("delta"),
                              F.when(cur[d] >= 8, F.lit("good")).when(cur[d] >= 6, F.lit("fair"))
                              .otherwise(F.lit("poor")).alias("band"))
                     for d in SCORE_DIMENSIONS])


# ---- recorded responses derived from the driver's conversations -----------------------

KINDS = ("analysis", "reasoning", "security", "deployment")
CATEGORIES = ["Testing", "CI/CD", "Performance", " backend framework ", "Observability", "Security", "Build Tool",
              "Developer Experience"]
PRIORITIES = ["high", "medium", "low", "urgent"]


def _js(c: Column) -> Column:
    """The text as a JSON string."""
    return F.btrim(F.to_json(F.array(c)), F.lit("[]"))


def _pick(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values) + 1).cast("int"))


def derive_ai_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded responses ``(repo_id, scan_id, kind, response)``: every assistant turn of every conversation.

    Conversations are dealt in turn to the repositories of the corpus. The four kinds follow each other; each
    eight turns of a conversation are a scan of its repository, ``scan_id = conv_id-(turn div 8)``. Field values are whole turn
    texts and their words; types vary on purpose (strings where numbers are
    expected, nulls, non-object list items) and some envelopes carry no choices, blank or non-JSON content.
    """
    last = read_table(spark, sf_dir, "documents", ["doc_id"]).agg(F.max("doc_id")).first()[0]
    repos = 1 + (last or 0) // FILES_PER_REPO
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    turns = conv.where(F.col("role") == "assistant")
    c, t, k4 = F.col("conv_id"), F.col("text"), F.expr("(turn div 2) % 4")
    words = F.split(F.regexp_replace(t, r"[^\p{L} ]", ""), " +")
    w = lambda k: F.coalesce(F.get(words, k), F.lit(""))
    n = F.length(t)
    analysis = F.concat(
        F.lit('{"frameworks": ['), _js(w(0)), F.lit(", "), _js(w(1)), F.lit('], "patterns": ['), _js(w(2)),
        F.lit(', 5, null], "concerns": '), F.when(c % 2 == 0, F.concat(F.lit("["), _js(w(3)), F.lit("]")))
        .otherwise(F.lit('"none"')), F.when(c % 3 == 1, F.concat(F.lit(', "projectContext": '), _js(w(5)))).otherwise(F.lit("")), F.lit(', "projectType": '), F.when(c % 3 == 0, F.lit("7")).otherwise(_js(w(4))),
        F.lit(', "summary": '), _js(t), F.lit("}"))

    def sugg(k, cur, sug):
        return F.concat(F.lit('{"category": '), _js(_pick(CATEGORIES, c + k)), F.lit(', "current": '), cur,
                        F.lit(', "suggested": '), sug, F.lit(', "reason": '), _js(t),
                        F.lit(', "benefit": '), _js(F.reverse(t)),
                        F.when((c + k) % 4 == 3, F.lit("")).otherwise(
                            F.concat(F.lit(', "priority": '), _js(_pick(PRIORITIES, c + k)))),
                        F.lit(', "effort": '), _js(_pick(LEVELS, c + 2 * k)), F.lit("}"))
    scores_cur = F.concat(F.lit('{"overall": '), (n % 13).cast("string"), F.lit(', "performance": '),
                          _js((n % 9).cast("string")), F.lit(', "developerExperience": null, "scalability": "abc"}'))
    scores_opt = F.when(c % 4 == 0, F.lit("7")).otherwise(
        F.concat(F.lit('{"overall": '), (n % 11).cast("string"), F.lit(', "performance": 8.5, '
                                                                       '"developerExperience": 9, "maintainability": -2, '
                                                                       '"scalability": true}')))
    reasoning = F.concat(
        F.lit('{"suggestions": ['), sugg(0, _js(w(0)), _js(w(1))), F.lit(", "), sugg(1, _js(w(2)), _js(w(3))),
        F.lit(', 42, '), sugg(2, F.lit('"Express"'), F.lit('"Fastify"')),
        F.lit('], "scores": {"current": '), scores_cur, F.lit(', "optimized": '), scores_opt,
        F.lit('}, "strengths": ['), _js(w(5)), F.lit(", 3, "), _js(w(6)), F.lit('], "summary": '),
        _js(t), F.lit("}"))
    security = F.concat(
        F.lit('{"findings": [{"severity": '), _js(_pick(SECURITY_SEVERITIES + ["severe"], c)),
        F.lit(', "category": '), _js(w(0)), F.lit(', "title": '), _js(t),
        F.lit(', "effort": "low"}, {"severity": "high"}, "loose"], "score": '),
        F.when(c % 5 == 0, F.lit("null")).when(c % 5 == 1, F.lit('"8.5"')).when(c % 5 == 2, F.lit("12"))
        .when(c % 5 == 3, F.lit('"abc"')).otherwise(F.lit("6")),
        F.lit(', "strengths": ['), _js(w(1)), F.lit(', false], "summary": '), _js(t), F.lit("}"))
    deployment = F.concat(
        F.lit('{"recommendations": [{"priority": '), _js(_pick(DEPLOY_PRIORITIES + ["asap"], c)),
        F.lit(', "title": '), _js(t), F.lit(', "impact": '), _js(w(2)),
        F.lit('}, null], "score": '), (n % 12).cast("string"), F.lit(', "strengths": [], "summary": 5}'))
    content = F.when(k4 == 0, analysis).when(k4 == 1, reasoning).when(k4 == 2, security).otherwise(deployment)
    key = c + F.col("turn")
    content = (F.when(key % 13 == 0, F.lit("   ")).when(key % 17 == 0, t)
               .when(key % 23 == 0, F.lit("null")).otherwise(content))
    envelope = F.when(key % 19 == 0, F.lit('{"choices": []}')).otherwise(
        F.concat(F.lit('{"choices": [{"message": {"content": '), _js(content), F.lit("}}]}")))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (k4 + 1).cast("int"))
    scan = F.concat_ws("-", c.cast("string"), F.expr("turn div 8").cast("string"))
    return turns.select(F.pmod(c, F.lit(repos)).alias("repo_id"), scan.alias("scan_id"), kind.alias("kind"), envelope.alias("response"))


def accepted(responses: DataFrame, kind: str) -> DataFrame:
    """(repo_id, scan_id, content): accepted responses of a kind."""
    scanned = scan_ai_responses(responses.where(F.col("kind") == kind))
    return scanned.where(F.col("reject_reason").isNull()).select("repo_id", "scan_id", "content")


def merged_suggestions(rule_results: DataFrame, responses: DataFrame) -> DataFrame:
    """H12 per repository and scan (null where a repository has none): rule findings joined with the scan's normalised reasoning response."""
    ai = accepted(responses, "reasoning").select("repo_id", "scan_id", normalize_reasoning(F.col("content")).alias("r"))
    scans = responses.select("repo_id", "scan_id").distinct().join(ai, ["repo_id", "scan_id"], "left")
    j = rule_results.select("repo_id", "findings").join(scans, "repo_id", "left")
    return j.select("repo_id", "scan_id", merge_suggestions(F.col("findings"), F.col("r.suggestions")).alias("merged"))
