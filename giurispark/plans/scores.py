"""Queries over complete scores: reasoning and citations together, the false-premise panel, reports against recounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from giurispark.functions import text
from giurispark.operators import consensus, reporting, scoring
from giurispark.operators.ranking import numbered
from giurispark.plans import grounding
from giurispark.plans.corpus import area_sql
from giurispark.session import cut
from giurispark.sources.tables import table

METHODS = ("initial_agreement", "tie_breaker", "recovery_agreement")


def _gold(spark: SparkSession, base: str) -> DataFrame:
    """Sizes of each task's profile: its own source is required, the rest acceptable."""
    return grounding._profiles(spark, base).groupBy("task_id").agg(F.count_if("resolving").alias("required"), F.count_if(~F.col("resolving")).alias("acceptable"))


def _panel_counts(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Per score: recorded methods, and calls of each judge."""
    method = F.coalesce("consensus_method", F.lit("single"))
    methods = table(spark, base, "criterion_results", "score_id", "consensus_method").groupBy("score_id").agg(*[F.count_if(method == m).alias(f"n_{m}") for m in METHODS], F.count_if(method == "unresolved").alias("n_method_unresolved"))
    votes = consensus.last_votes(table(spark, base, "judge_votes"), ["score_id", "criterion_id"])
    return methods, votes.groupBy("score_id").agg(*[F.count_if(F.col("judge") == j).alias(f"calls_{j.lower()}") for j in "ABC"])


def _complete(spark: SparkSession, base: str) -> DataFrame:
    """Every score with criteria, methods, calls and citations, written once: reports read it more than once."""
    kinds = table(spark, base, "benchmark_tasks", "task_id", "task_type", "macro_area")
    scores = table(spark, base, "task_scores", "score_id", "run_id", "task_id", "model", "score").join(kinds, "task_id", "left")
    kind = text.task_kind(F.col("task_type"), F.col("task_id"))
    criteria = table(spark, base, "criterion_results", "score_id", "verdict", "scoring_type")
    reasoning = scoring.verdicts(scoring.counters(criteria)).withColumnRenamed("score", "reasoning_score")
    methods, calls = _panel_counts(spark, base)
    cited = scoring.citation_scores(cut(grounding._grounded(spark, base)), _gold(spark, base)).drop("task_id", "required", "acceptable")
    rows = scores.withColumns({"task_kind": kind, "standard": kind != "bullshit"}).join(reasoning, "score_id").join(methods, "score_id", "left").join(calls, "score_id", "left").join(cited, "score_id", "left").join(_gold(spark, base), "task_id", "left")
    return cut(scoring.scored_citations(rows))


def batch_metrics(spark: SparkSession, base: str) -> DataFrame:
    """All metrics of the batch in one row."""
    return _complete(spark, base).agg(*scoring.batch_metrics())


def batch_metrics_by_model(spark: SparkSession, base: str) -> DataFrame:
    return _complete(spark, base).groupBy("model").agg(*scoring.batch_metrics())


TASK_COLUMNS = (
    "run_id", "model", "task_id", "task_kind", "standard", "citation_applicable", "reasoning_score", "all_pass", "status", "score", "citation_score", "citation_coverage_score", "citation_relevance_score", "citation_fabrication_rate", "citation_verdict",
    "citation_scoring_status", "citation_hard_fail", "citation_required_count", "citation_required_matched_count", "citation_acceptable_count", "citation_acceptable_matched_count", "citations_extracted_count", "citations_relevant_count",
    "citations_outside_gold_count", "citations_fabricated_count", "citations_unresolved_count", "n_criteria", "n_passed", "n_unresolved",
)


def task_columns(spark: SparkSession, base: str) -> DataFrame:
    """Task rows of a report with all their columns."""
    stamp = F.when(F.contains("run_id", F.lit("/")), F.substring_index("run_id", "/", -1)).otherwise("")
    area = F.when(F.length(F.coalesce("macro_area", F.lit(""))) > 0, text.area(F.col("macro_area"))).otherwise(text.area_of_task(F.col("task_id")))
    source = F.concat(F.when(F.col("standard"), "").otherwise("bullshit/"), "run_id", F.lit("/scores.json"))
    return _complete(spark, base).select("score_id", *TASK_COLUMNS, stamp.alias("run_timestamp"), source.alias("source_path"), text.series_label(F.col("model"), stamp).alias("series_label"), area.alias("macro_area"), (~F.col("standard")).alias("is_bullshit_task"))


def leaderboard_metrics(spark: SparkSession, base: str) -> DataFrame:
    """The leaderboard's metrics on complete scores, first score of each task in a run."""
    frame = cut(reporting.keep_first(_complete(spark, base), ["run_id", "model", "task_id"], ["score_id"]).where("standard"))
    done, cited = F.col("status") == "complete", F.col("citation_scoring_status") == "complete"
    safe = scoring.safe_rate
    mean = lambda c: F.round(F.avg(F.when(cited, F.col(c))), 6)
    board = frame.groupBy("run_id", "model").agg(
        F.count("*").alias("n_standard_tasks"), F.count_if(done).alias("n_complete"), F.count_if(~done).alias("n_incomplete"), safe(F.count_if(done & F.col("all_pass")), F.count_if(done)).alias("all_pass_rate"),
        F.count_if(cited).alias("n_citation_complete"), safe(F.count_if(cited), F.count("*")).alias("citation_scoring_coverage"), mean("citation_score").alias("mean_citation_score"), mean("citation_coverage_score").alias("mean_citation_coverage"),
        mean("citation_relevance_score").alias("mean_citation_relevance"), safe(F.count_if(cited & (F.col("citation_score") == 1.0)), F.count_if(cited)).alias("citation_perfect_rate"),
        safe(F.count_if(F.col("citation_verdict") == "nc"), F.count("*")).alias("citation_nc_rate"), safe(F.count_if(F.col("citation_verdict") == "unresolved"), F.count("*")).alias("citation_unresolved_rate"),
        safe(F.count_if(cited & F.col("citation_hard_fail")), F.count_if(cited)).alias("citation_hard_fail_rate"), mean("citation_fabrication_rate").alias("mean_task_fabrication_rate"),
        safe(F.coalesce(F.sum(F.when(cited, F.col("citations_fabricated_count"))), F.lit(0)), F.sum(F.when(cited, F.col("citations_extracted_count")))).alias("global_fabrication_rate"),
    )
    verdicts = table(spark, base, "criterion_results", "score_id", "criterion_id", "verdict").groupBy("score_id", "criterion_id").agg(F.min("verdict").alias("verdict"))
    resolved = F.col("verdict").isin("pass", "fail")
    rates = verdicts.join(frame.where(done).select("score_id", "run_id", "model"), "score_id").groupBy("run_id", "model").agg(safe(F.count_if(F.col("verdict") == "pass"), F.count_if(resolved)).alias("criterion_pass_rate"), safe(F.count_if(resolved), F.count("*")).alias("criterion_resolution_coverage"))
    return board.join(rates, ["run_id", "model"], "left")


def report_mapping(spark: SparkSession, base: str) -> DataFrame:
    """Statuses of each answer: what is recounted or what its report says, whichever is more. The report holds what the recorded candidates tell."""
    statuses = ("resolved_local_registry_exact", "ambiguous_local_registry", "not_found_in_index")
    resolved = grounding._resolved(spark, base)
    recount = resolved.groupBy("score_id").agg(*[F.count_if(F.col("final_status") == s).alias(s) for s in statuses])
    known = table(spark, base, "registry_candidates", "citation_id").groupBy("citation_id").agg(F.count("*").alias("n"))
    own = table(spark, base, "citations", "citation_id", "score_id").distinct().join(known, "citation_id", "left")
    reported = own.groupBy("score_id").agg(F.count_if(F.col("n") == 1).alias(statuses[0]), F.count_if(F.col("n") > 1).alias(statuses[1]), F.count_if(F.col("n").isNull()).alias(statuses[2]))
    return scoring.greatest_counts(recount, reported, "score_id", statuses)


# ---- false-premise panel -------------------------------------------------------------------


def false_premise_panel(spark: SparkSession, base: str) -> DataFrame:
    """Every false-premise task under one model, answered or not: the last answer counts, none fails."""
    tasks = table(spark, base, "benchmark_tasks", "task_id", "task_type", "macro_area").where("task_type = 'bullshit'").select("task_id", text.area(F.col("macro_area")).alias("area"))
    answers = table(spark, base, "task_scores", "task_id", "score_id", "model_output", "model").where("model = 'falena-8b'").groupBy("task_id").agg(F.max(F.struct("score_id", "model_output")).alias("x")).select("task_id", "x.*")
    return scoring.panel_of_tasks(tasks, answers, table(spark, base, "criterion_results", "score_id", "verdict")).select("task_id", "area", "score_id", "verdict", "score", "pass_rate")


def false_premise_diagnostics(spark: SparkSession, base: str) -> DataFrame:
    """Methods and judge calls per false-premise answer."""
    mine = table(spark, base, "benchmark_tasks").where("task_type = 'bullshit'").select("task_id").join(table(spark, base, "task_scores", "score_id", "task_id"), "task_id").select("score_id")
    criteria = table(spark, base, "criterion_results", "score_id", F.col("consensus_method").alias("method")).join(mine, "score_id")
    calls = consensus.last_votes(table(spark, base, "judge_votes"), ["score_id", "criterion_id"]).join(mine, "score_id")
    return scoring.panel_diagnostics(criteria, calls, "score_id")


def false_premise_ranked(spark: SparkSession, base: str) -> DataFrame:
    """Runs on false-premise tasks in order of their detection rate, those without one last."""
    frame = reporting.keep_first(_complete(spark, base).withColumns({"verdict": F.when(F.col("score") == 1.0, "pass").when(F.col("score") == 0.0, "fail").otherwise("unresolved"), "scoring_status": F.col("status"), "series_label": F.lit("")}), ["run_id", "model", "task_id"], ["score_id"])
    board = reporting.false_premise_board(frame).drop("series_label")
    return numbered(board, [], [F.col("detection_rate").desc_nulls_last(), F.col("run_id").asc(), F.col("model").asc()])


QUERIES = {f.__name__: f for f in (batch_metrics, batch_metrics_by_model, task_columns, leaderboard_metrics, report_mapping, false_premise_panel, false_premise_diagnostics, false_premise_ranked)}

R = lambda n, d: f"round(coalesce(({n}) / nullif({d}, 0), 0.0), 6)"
S = lambda n, d: f"round(({n}) / nullif({d}, 0), 6)"
KIND = "CASE WHEN coalesce(b.task_type, '') = 'bullshit' OR starts_with(t.task_id, 'bullshit/') THEN 'bullshit' ELSE coalesce(nullif(b.task_type, ''), 'standard') END"
COMPLETE = grounding.GROUNDED.replace("CASE WHEN f.final_status <> 'not_found_in_index' THEN NULL", "f.matched, CASE WHEN f.final_status <> 'not_found_in_index' THEN NULL", 1) + f""",
counted AS (SELECT score_id, count(*) AS n_criteria, count(*) FILTER (verdict = 'pass') AS n_passed, count(*) FILTER (verdict = 'unresolved') AS n_unresolved, count(*) FILTER (scoring_type = 'required') AS nr, count(*) FILTER (scoring_type = 'required' AND verdict = 'pass') AS nrp,
  count(*) FILTER (scoring_type = 'required' AND verdict = 'unresolved') AS nru, count(*) FILTER (scoring_type = 'bonus') AS nb, count(*) FILTER (scoring_type = 'bonus' AND verdict = 'pass') AS nbp, count(*) FILTER (scoring_type = 'bonus' AND verdict = 'unresolved') AS nbu,
  count(*) FILTER (consensus_method = 'initial_agreement') AS mi, count(*) FILTER (consensus_method = 'tie_breaker') AS mt, count(*) FILTER (consensus_method = 'recovery_agreement') AS mr, count(*) FILTER (consensus_method = 'unresolved') AS mu FROM criterion_results GROUP BY 1),
calls AS (SELECT score_id, count(*) FILTER (judge = 'A') AS ca, count(*) FILTER (judge = 'B') AS cb, count(*) FILTER (judge = 'C') AS cc FROM (SELECT DISTINCT score_id, criterion_id, upper(trim(judge_id, E' \\t\\n\\r')) AS judge FROM judge_votes) GROUP BY 1),
gold AS (SELECT task_id, count(*) FILTER (resolving) AS req, count(*) FILTER (NOT resolving) AS acc FROM profiles GROUP BY 1),
cit AS (SELECT score_id, count(*) AS n, count(*) FILTER (relation IN ('issue_aligned', 'retrieved_only')) AS rel, count(*) FILTER (relation = 'outside_profile') AS outp, count(*) FILTER (relation = 'fabricated_or_not_found') AS fab, count(*) FILTER (relation = 'unresolved') AS unr,
  count(DISTINCT matched) FILTER (relation = 'issue_aligned') AS hit, count(DISTINCT matched) FILTER (relation = 'retrieved_only') AS acchit,
  count(*) FILTER (final_status IN ('resolved_local_registry_exact', 'resolved_local_registry_incomplete', 'resolved_local_registry_metadata_mismatch', 'ambiguous_local_registry')) AS econf, count(*) FILTER (final_status IN ('not_found_in_index', 'resolver_error', 'citation_extraction_error')) AS eunr FROM grounded GROUP BY 1),
base AS (SELECT t.score_id, t.run_id, t.task_id, t.model, t.score, b.macro_area, {KIND} AS task_kind, {KIND} <> 'bullshit' AS standard, c.* EXCLUDE (score_id), ca, cb, cc, coalesce(n, 0) AS n, coalesce(rel, 0) AS rel, coalesce(outp, 0) AS outp, coalesce(fab, 0) AS fab, coalesce(unr, 0) AS unr, least(coalesce(hit, 0), coalesce(req, 0)) AS reqhit, coalesce(acchit, 0) AS acchit,
  coalesce(econf, 0) AS econf, coalesce(eunr, 0) AS eunr, coalesce(req, 0) AS req, coalesce(acc, 0) AS acc, CASE WHEN nru > 0 THEN 'incomplete' ELSE 'complete' END AS status, CASE WHEN nru = 0 THEN nr > 0 AND nrp = nr END AS all_pass, CASE WHEN nru = 0 THEN CASE WHEN nr > 0 AND nrp = nr THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS rs
  FROM task_scores t LEFT JOIN benchmark_tasks b USING (task_id) JOIN counted c USING (score_id) LEFT JOIN calls USING (score_id) LEFT JOIN cit USING (score_id) LEFT JOIN gold g ON g.task_id = t.task_id),
shares AS (SELECT *, n - fab - unr AS ev, {S('fab', 'n')} AS fabrate, {S('reqhit', 'req')} AS cov, {S('rel', 'n - fab - unr')} AS relv FROM base),
full_ AS (SELECT *, round((coalesce(cov, relv) + coalesce(relv, cov)) / 2, 6) AS cs, CASE WHEN NOT standard THEN 'not_applicable' WHEN n = 0 THEN 'not_cited' WHEN ev + fab = 0 THEN 'incomplete' ELSE 'complete' END AS st FROM shares),
scores_ AS (SELECT *, CASE st WHEN 'not_applicable' THEN 'not_applicable' WHEN 'not_cited' THEN 'nc' WHEN 'incomplete' THEN 'unresolved' ELSE CASE WHEN coalesce(cov, 1.0) = 1.0 AND fab = 0 THEN 'pass' ELSE 'fail' END END AS cv FROM full_)
"""
_c = lambda w: f"count(*) FILTER ({w})"
_s = lambda c, w="standard": f"CAST(coalesce(sum({c}) FILTER ({w}), 0) AS BIGINT)"
_DONE = "status = 'complete'"
_cited = "standard AND st = 'complete'"
_PARTS = {
    "n_tasks": "count(*)", "n_complete": _c("status = 'complete'"), "n_incomplete": _c("status <> 'complete'"), "n_allpass": _c("status = 'complete' AND all_pass"), "allpass_rate": R(_c("status = 'complete' AND all_pass"), _c("status = 'complete'")),
    "required_criterion_pass_rate": R(_s("nrp", "status = 'complete'"), _s("nr", "status = 'complete'")), "bonus_pass_rate": S(_s("nbp", "status = 'complete'"), f"({_s('nb', _DONE)} - {_s('nbu', _DONE)})"),
    "unresolved_rate": R("sum(n_unresolved)", "sum(n_criteria)"), "n_unresolved": "CAST(sum(n_unresolved) AS BIGINT)", "criteria_evaluated": "CAST(sum(n_criteria) AS BIGINT)", "reasoning_allpass_rate": R(_c("status = 'complete' AND all_pass"), _c("status = 'complete'")),
    "judge_calls_a": _s("ca", "true"), "judge_calls_b": _s("cb", "true"), "judge_calls_c": _s("cc", "true"), "initial_agreements": _s("mi", "true"), "tie_breakers": _s("mt", "true"), "recoveries": _s("mr", "true"), "unresolved_criteria": _s("mu", "true"), "judge_c_evaluated_criteria": _s("cc", "true"),
    "citation_complete_tasks": _c(_cited), "citation_incomplete_tasks": _c("standard AND cv = 'unresolved'"), "citation_existence_unresolved_tasks": _c("standard AND eunr > 0 AND econf = 0"), "citation_not_cited_tasks": _c("standard AND cv = 'nc'"), "citation_not_applicable_tasks": _c("NOT standard"),
    "citation_pass_tasks": _c(f"{_cited} AND cv = 'pass'"), "citation_fail_tasks": _c(f"{_cited} AND cv = 'fail'"), "citation_perfect_tasks": _c(f"{_cited} AND cs = 1.0"), "citation_perfect_rate": R(_c(f"{_cited} AND cs = 1.0"), f"count(cs) FILTER ({_cited})"),
    "citation_mean_score": f"round(avg(cs) FILTER ({_cited}), 6)", "citation_mean_coverage_score": f"round(avg(cov) FILTER ({_cited}), 6)", "citation_mean_relevance_score": f"round(avg(relv) FILTER ({_cited}), 6)",
    "citation_all_pass_rate": R(_c(f"{_cited} AND cv = 'pass'"), _c(f"{_cited} AND cv IN ('pass', 'fail')")), "citation_pass_rate": R(_c(f"{_cited} AND cv = 'pass'"), _c(_cited)), "citation_fail_rate": R(_c(f"{_cited} AND cv = 'fail'"), _c(_cited)),
    "citation_nc_rate": R(_c("standard AND cv = 'nc'"), _c("standard")), "citation_unresolved_rate": R(_c("standard AND cv = 'unresolved'"), _c("standard")), "citation_complete_coverage": R(_c(_cited), _c("standard")), "citation_scoring_coverage": R(_c(_cited), _c("standard")),
    "citation_required_total": _s("req"), "citation_required_matched_total": _s("reqhit"), "citation_required_missing_total": f"{_s('req')} - {_s('reqhit')}", "citation_required_unresolved_total": _s("req", "standard AND st = 'incomplete'"), "required_citation_coverage_rate": R(_s("reqhit"), _s("req")),
    "citation_minimum_complete_tasks": _c(f"{_cited} AND cov = 1.0"), "citation_minimum_incomplete_tasks": _c(f"{_cited} AND cov < 1.0"), "citation_relevant_rate": R(_s("rel"), _s("ev")), "citation_outside_gold_tasks": _c("standard AND outp > 0"),
    "citation_fabrication_rate": R(_s("fab"), f"({_s('ev')} + {_s('fab')})"), "confirmed_fabrication_rate": R(_s("fab"), f"({_s('ev')} + {_s('fab')})"), "unresolved_verification_rate": R(_s("eunr"), _s("ev")), "tasks_with_citations": _c("standard AND n > 0"),
    "citation_gold_total": f"{_s('req')} + {_s('acc')}", "citations_extracted_total": _s("n"), "citations_matched_gold_total": f"{_s('reqhit')} + {_s('acchit')}", "citations_relevant_total": _s("rel"), "citations_evaluable_total": _s("ev"), "citations_outside_gold_total": _s("outp"),
    "citations_fabricated_total": _s("fab"), "citations_unresolved_total": _s("unr"), "citation_extraction_error_total": "CAST(0 AS BIGINT)", "citation_extraction_error_tasks": "CAST(0 AS BIGINT)",
}
_BATCH = ", ".join(f"{v} AS {k}" for k, v in _PARTS.items())
_NAMES = {
    "reasoning_score": "rs", "citation_score": "cs", "citation_coverage_score": "cov", "citation_relevance_score": "relv", "citation_fabrication_rate": "fabrate", "citation_verdict": "cv", "citation_scoring_status": "st", "citation_hard_fail": "fab > 0", "citation_required_count": "req",
    "citation_required_matched_count": "reqhit", "citation_acceptable_count": "acc", "citation_acceptable_matched_count": "acchit", "citations_extracted_count": "n", "citations_relevant_count": "rel", "citations_outside_gold_count": "outp", "citations_fabricated_count": "fab", "citations_unresolved_count": "unr", "citation_applicable": "standard",
}
_FIRST = ", firsts AS (SELECT * FROM scores_ QUALIFY row_number() OVER (PARTITION BY run_id, model, task_id ORDER BY score_id) = 1)\n"
ORACLE = {
    "batch_metrics": COMPLETE + f"SELECT {_BATCH} FROM scores_",
    "batch_metrics_by_model": COMPLETE + f"SELECT model, {_BATCH} FROM scores_ GROUP BY model",
    "task_columns": COMPLETE + "SELECT score_id, " + ", ".join(f"{_NAMES.get(c, c)} AS {c}" for c in TASK_COLUMNS) + f""", split_part(run_id, '/', 2) AS run_timestamp, CASE WHEN standard THEN '' ELSE 'bullshit/' END || run_id || '/scores.json' AS source_path, model || ' · ' || split_part(run_id, '/', 2) AS series_label,
  CASE WHEN coalesce(macro_area, '') <> '' THEN {area_sql('macro_area')} ELSE {area_sql("split_part(task_id, '/', 1)")} END AS macro_area, NOT standard AS is_bullshit_task FROM scores_""",
    "leaderboard_metrics": COMPLETE + _FIRST + f""", v AS (SELECT score_id, criterion_id, min(verdict) AS verdict FROM criterion_results GROUP BY ALL)
SELECT * FROM (SELECT run_id, model, count(*) AS n_standard_tasks, {_c("status = 'complete'")} AS n_complete, {_c("status <> 'complete'")} AS n_incomplete, {S(_c("status = 'complete' AND all_pass"), _c("status = 'complete'"))} AS all_pass_rate, {_c("st = 'complete'")} AS n_citation_complete, {S(_c("st = 'complete'"), 'count(*)')} AS citation_scoring_coverage,
  round(avg(cs) FILTER (st = 'complete'), 6) AS mean_citation_score, round(avg(cov) FILTER (st = 'complete'), 6) AS mean_citation_coverage, round(avg(relv) FILTER (st = 'complete'), 6) AS mean_citation_relevance, {S(_c("st = 'complete' AND cs = 1.0"), _c("st = 'complete'"))} AS citation_perfect_rate, {S(_c("cv = 'nc'"), 'count(*)')} AS citation_nc_rate,
  {S(_c("cv = 'unresolved'"), 'count(*)')} AS citation_unresolved_rate, {S(_c("st = 'complete' AND fab > 0"), _c("st = 'complete'"))} AS citation_hard_fail_rate, round(avg(fabrate) FILTER (st = 'complete'), 6) AS mean_task_fabrication_rate, {S("coalesce(sum(fab) FILTER (st = 'complete'), 0)", "sum(n) FILTER (st = 'complete')")} AS global_fabrication_rate
  FROM firsts WHERE standard GROUP BY run_id, model) LEFT JOIN (SELECT run_id, model, {S(_c("verdict = 'pass'"), _c("verdict IN ('pass', 'fail')"))} AS criterion_pass_rate, {S(_c("verdict IN ('pass', 'fail')"), 'count(*)')} AS criterion_resolution_coverage FROM v JOIN (SELECT score_id, run_id, model FROM firsts WHERE standard AND status = 'complete') USING (score_id) GROUP BY ALL) USING (run_id, model)""",
    "report_mapping": grounding.RESOLVED + f""", a AS (SELECT score_id, {_c("final_status = 'resolved_local_registry_exact'")} AS x, {_c("final_status = 'ambiguous_local_registry'")} AS y, {_c("final_status = 'not_found_in_index'")} AS z FROM final GROUP BY 1),
b AS (SELECT score_id, {_c('n = 1')} AS x, {_c('n > 1')} AS y, {_c('n IS NULL')} AS z FROM (SELECT DISTINCT citation_id, score_id FROM citations) LEFT JOIN (SELECT citation_id, count(*) AS n FROM registry_candidates GROUP BY 1) USING (citation_id) GROUP BY 1)
SELECT score_id, greatest(coalesce(a.x, 0), coalesce(b.x, 0)) AS resolved_local_registry_exact, greatest(coalesce(a.y, 0), coalesce(b.y, 0)) AS ambiguous_local_registry, greatest(coalesce(a.z, 0), coalesce(b.z, 0)) AS not_found_in_index FROM a FULL JOIN b USING (score_id)""",
    "false_premise_panel": f"""WITH ans AS (SELECT task_id, arg_max(score_id, score_id) AS score_id, arg_max({{'m': model_output}}, score_id) AS x FROM task_scores WHERE model = 'falena-8b' GROUP BY 1), c AS (SELECT score_id, count(*) AS n, {_c("verdict = 'pass'")} AS p, {_c("verdict = 'unresolved'")} AS u FROM criterion_results GROUP BY 1),
j AS (SELECT b.task_id, {area_sql('b.macro_area')} AS area, a.score_id, n, p, u, trim(coalesce(a.x.m, ''), E' \\t\\n\\r\\u00a0') = '' AS blank FROM benchmark_tasks b LEFT JOIN ans a USING (task_id) LEFT JOIN c USING (score_id) WHERE b.task_type = 'bullshit'),
v AS (SELECT *, CASE WHEN blank THEN 'fail' WHEN n IS NULL OR u > 0 THEN 'unresolved' WHEN p = n THEN 'pass' ELSE 'fail' END AS verdict FROM j) SELECT task_id, area, score_id, verdict, CASE verdict WHEN 'pass' THEN 1.0::DOUBLE WHEN 'fail' THEN 0.0::DOUBLE END AS score, {S('p', 'n - u')} AS pass_rate FROM v""",
    "false_premise_diagnostics": f"""WITH mine AS (SELECT score_id FROM task_scores JOIN benchmark_tasks USING (task_id) WHERE task_type = 'bullshit'), m AS (SELECT score_id, count(*) AS criteria_evaluated, {_c("consensus_method = 'initial_agreement'")} AS initial_agreements, {_c("consensus_method = 'tie_breaker'")} AS tie_breakers, {_c("consensus_method = 'recovery_agreement'")} AS recoveries, {_c("consensus_method = 'unresolved'")} AS unresolved_criteria
  FROM criterion_results JOIN mine USING (score_id) GROUP BY 1), k AS (SELECT score_id, {_c("judge = 'A'")} AS calls_a, {_c("judge = 'B'")} AS calls_b, {_c("judge = 'C'")} AS calls_c, {_c("judge = 'C'")} > 0 AS judge_c_used FROM (SELECT DISTINCT score_id, criterion_id, upper(trim(judge_id, E' \\t\\n\\r')) AS judge FROM judge_votes JOIN mine USING (score_id)) GROUP BY 1)
SELECT * FROM m LEFT JOIN k USING (score_id)""",
    "false_premise_ranked": COMPLETE + _FIRST + f""", w AS (SELECT *, CASE score WHEN 1.0 THEN 'pass' WHEN 0.0 THEN 'fail' ELSE 'unresolved' END AS verdict FROM firsts WHERE NOT standard),
brd AS (SELECT run_id, model, count(*) AS n, {_c("status = 'complete'")} AS n_complete, {S(_c("status = 'complete' AND verdict = 'pass'"), _c("status = 'complete'"))} AS detection_rate, {S(_c("verdict = 'unresolved' OR status = 'incomplete'"), 'count(*)')} AS unresolved_rate FROM w GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY detection_rate DESC NULLS LAST, run_id, model) AS position FROM brd""",
}
