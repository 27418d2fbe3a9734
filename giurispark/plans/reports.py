"""Queries over scores and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from giurispark.functions import text
from giurispark.operators import reporting, scoring
from giurispark.operators.ranking import numbered
from giurispark.plans.corpus import area_sql
from giurispark.session import cut
from giurispark.sources.tables import table


def _criteria(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "criterion_results", "score_id", "task_id", "criterion_id", "title", "verdict", "scoring_type")


def _citations(spark: SparkSession, base: str) -> DataFrame:
    """Per score: citations, those without any candidate, with several, and with one."""
    known = table(spark, base, "registry_candidates", "citation_id").groupBy("citation_id").agg(F.count("*").alias("n"))
    own = table(spark, base, "citations", "citation_id", "score_id").distinct()
    return own.join(known, "citation_id", "left").groupBy("score_id").agg(
        F.count("*").alias("citations"), F.count_if(F.col("n").isNull()).alias("fabricated"), F.count_if(F.col("n") > 1).alias("unresolved_citations"), F.count_if(F.col("n") == 1).alias("confirmed")
    )


def _scores(spark: SparkSession, base: str) -> DataFrame:
    scored = scoring.verdicts(scoring.counters(_criteria(spark, base)))
    keys = table(spark, base, "task_scores", "score_id", "task_id", "model", "run_id")
    return keys.join(scored, "score_id").join(_citations(spark, base), "score_id", "left")


def task_scores_derived(spark: SparkSession, base: str) -> DataFrame:
    scored = scoring.verdicts(scoring.counters(_criteria(spark, base)))
    return scored.withColumn("reasoning", scoring.sentence(scored))


def score_differences(spark: SparkSession, base: str) -> DataFrame:
    """Recorded against derived scores."""
    derived = scoring.verdicts(scoring.counters(_criteria(spark, base))).select("score_id", "status", F.col("all_pass").alias("derived"))
    return table(spark, base, "task_scores", "score_id", "scoring_status", "all_pass").join(derived, "score_id", "left").groupBy("scoring_status", "all_pass", "status", "derived").agg(F.count("*").alias("n"))


def batch_summary(spark: SparkSession, base: str) -> DataFrame:
    return scoring.summary(_scores(spark, base))


def summary_by_area(spark: SparkSession, base: str) -> DataFrame:
    return scoring.summary_by_area(_scores(spark, base))


def summary_by_model(spark: SparkSession, base: str) -> DataFrame:
    return _scores(spark, base).groupBy("model").agg(*scoring.batch_aggregates())


def tasks_answers(spark: SparkSession, base: str) -> DataFrame:
    tasks = table(spark, base, "benchmark_tasks", "task_id", "macro_area", F.size("criteria").alias("n_criteria"))
    joined = scoring.answered(tasks, table(spark, base, "task_scores", "score_id", "task_id", "model"))
    return joined.groupBy("model", text.area(F.col("macro_area")).alias("area")).agg(F.count("*").alias("answers"), F.countDistinct("task_id").alias("tasks"), F.sum("n_criteria").alias("criteria"))


def tasks_unmatched(spark: SparkSession, base: str) -> DataFrame:
    """Answers to standard tasks only: what a narrower task set leaves out."""
    tasks = table(spark, base, "benchmark_tasks").where("task_type = 'standard'").select("task_id")
    return scoring.unmatched(tasks, table(spark, base, "task_scores", "score_id", "task_id")).select("score_id", "task_id")


def _false_premise(spark: SparkSession, base: str) -> DataFrame:
    tasks = table(spark, base, "benchmark_tasks", "task_id", "task_type", "macro_area").where("task_type = 'bullshit'")
    answers = table(spark, base, "task_scores", "score_id", "task_id", "model", "model_output").join(tasks, "task_id")
    return scoring.false_premise(answers, _criteria(spark, base).select("score_id", "verdict")).withColumn("area", text.area(F.col("macro_area")))


def false_premise_scores(spark: SparkSession, base: str) -> DataFrame:
    return _false_premise(spark, base).select("score_id", "verdict", "score", "pass_rate")


def false_premise_summary(spark: SparkSession, base: str) -> DataFrame:
    return scoring.false_premise_summary(_false_premise(spark, base), "area", "model")


def _frame(spark: SparkSession, base: str) -> DataFrame:
    tasks = table(spark, base, "benchmark_tasks", "task_id", "task_type", "macro_area")
    scores = table(spark, base, "task_scores", "score_id", "run_id", "task_id", "model", "score", "all_pass", "scoring_status")
    joined = scores.join(tasks, "task_id", "left").join(_citations(spark, base), "score_id", "left")
    n = F.coalesce("citations", F.lit(0))
    return reporting.task_frame(joined.withColumns({
        "citation_verdict": F.when(n == 0, "nc").when(F.col("fabricated") > 0, "fail").otherwise("pass"), "citation_status": F.when(n == 0, "not_cited").otherwise("complete"),
        "citation_score": F.round(F.try_divide(F.col("confirmed"), n), 6), "verdict": F.when(F.col("score") == 1.0, "pass").when(F.col("score") == 0.0, "fail").otherwise("unresolved"),
    }))


def _frames(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    tasks = cut(reporting.first_tasks(_frame(spark, base)))  # both frames and their reports read it
    return tasks, reporting.criterion_frame(tasks, _criteria(spark, base).drop("task_id"))


def task_rows(spark: SparkSession, base: str) -> DataFrame:
    return _frame(spark, base).select("score_id", "run_timestamp", "series_label", "task_kind", "standard", "macro_area", "citation_applicable", "citation_verdict", "citation_status", "citation_score")


def keep_first_dedup(spark: SparkSession, base: str) -> DataFrame:
    return reporting.first_tasks(_frame(spark, base)).select("run_id", "model", "task_id", "score_id")


def leaderboard(spark: SparkSession, base: str) -> DataFrame:
    return reporting.ranked(reporting.leaderboard(*_frames(spark, base))).drop("series_label")


def metrics_by_area(spark: SparkSession, base: str) -> DataFrame:
    return reporting.by_area(*_frames(spark, base)).drop("series_label")


def false_premise_leaderboard(spark: SparkSession, base: str) -> DataFrame:
    return reporting.false_premise_board(reporting.first_tasks(_frame(spark, base))).drop("series_label")


def status_distribution(spark: SparkSession, base: str) -> DataFrame:
    bucket = F.when(F.col("citation_verdict") == "nc", "nc").when(F.col("scoring_status") == "incomplete", "incomplete").when(F.col("citation_verdict") == "fail", "unresolved").otherwise("complete")
    return reporting.status_distribution(reporting.first_tasks(_frame(spark, base)).withColumn("bucket", bucket))


def criterion_heatmap(spark: SparkSession, base: str) -> DataFrame:
    return reporting.heatmap(_frames(spark, base)[1], ["macro_area", "title"])


def run_log(spark: SparkSession, base: str) -> DataFrame:
    """Counts per series."""
    tasks, criteria = _frames(spark, base)
    return tasks.groupBy("model").agg(F.count("*").alias("tasks"), F.countDistinct("task_id").alias("distinct_tasks"), F.countDistinct("run_id").alias("runs"), F.count_if("standard").alias("standard"))


def latest_runs(spark: SparkSession, base: str) -> DataFrame:
    """Latest run of each model, the paths as a result folder would have them."""
    scores = table(spark, base, "task_scores", "run_id", "task_id").join(table(spark, base, "benchmark_tasks", "task_id", "task_type"), "task_id", "left")
    prefix = F.when(text.task_kind(F.col("task_type"), F.col("task_id")) == "bullshit", "bullshit/").otherwise("")
    paths = scores.select(F.concat(prefix, "run_id", F.lit("/scores.json")).alias("path")).distinct()
    family, model, stamp = text.path_parts(F.col("path"))
    return reporting.latest_runs(paths.withColumns({"family": family, "model": model, "run_timestamp": stamp})).select("family", "model", "run_timestamp", "path", text.run_id(F.col("model"), F.col("run_timestamp")).alias("run_id"))


def runs_since(spark: SparkSession, base: str) -> DataFrame:
    """Runs of two models from a moment on; times compare as text."""
    runs = table(spark, base, "task_scores", "run_id", "model").groupBy("run_id", "model").agg(F.count("*").alias("scores"))
    return runs.where((F.substring_index("run_id", "/", -1) >= "20240601") & F.col("model").isin("aquila-mini", "etna-pro"))


def task_ids(spark: SparkSession, base: str) -> DataFrame:
    """Sequential ids per area, in order of filing."""
    tasks = table(spark, base, "benchmark_tasks", "task_id", "macro_area", "created_at").withColumn("area", text.area(F.col("macro_area")))
    placed = numbered(tasks, ["area"], [F.col("created_at").asc(), F.col("task_id").asc()], "n")
    number = F.col("n").cast("string")
    return placed.select("task_id", F.concat_ws("/", "area", F.when(F.length(number) >= 4, number).otherwise(F.lpad(number, 4, "0"))).alias("new_id"))


QUERIES = {f.__name__: f for f in (
    task_scores_derived, score_differences, batch_summary, summary_by_area, summary_by_model, tasks_answers, tasks_unmatched, false_premise_scores, false_premise_summary,
    task_rows, keep_first_dedup, leaderboard, metrics_by_area, false_premise_leaderboard, status_distribution, criterion_heatmap, run_log, latest_runs, runs_since, task_ids,
)}

RATE = lambda n, d: f"round(coalesce(({n}) / nullif({d}, 0), 0.0), 6)"
SAFE = lambda n, d: f"round(({n}) / nullif({d}, 0), 6)"
SCORED = f"""WITH counted AS (SELECT score_id, count(*) AS n_criteria, count(*) FILTER (verdict = 'pass') AS n_passed, count(*) FILTER (verdict = 'unresolved') AS n_unresolved,
  """ + ", ".join(
    f"count(*) FILTER (scoring_type = '{k}') AS n_{k}, count(*) FILTER (scoring_type = '{k}' AND verdict = 'pass') AS n_{k}_passed, count(*) FILTER (scoring_type = '{k}' AND verdict = 'unresolved') AS n_{k}_unresolved" for k in ("required", "bonus")
) + f"""
  FROM criterion_results GROUP BY score_id),
scored AS (SELECT *, CASE WHEN n_required_unresolved > 0 THEN 'incomplete' ELSE 'complete' END AS status, CASE WHEN n_required_unresolved = 0 THEN n_required > 0 AND n_required_passed = n_required END AS all_pass,
  CASE WHEN n_required_unresolved = 0 THEN CASE WHEN n_required > 0 AND n_required_passed = n_required THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS score,
  CASE WHEN n_required_unresolved = 0 THEN {RATE('n_required_passed', 'n_required')} END AS required_pass_rate, {SAFE('n_bonus_passed', 'n_bonus - n_bonus_unresolved')} AS bonus_pass_rate, {RATE('n_unresolved', 'n_criteria')} AS unresolved_rate FROM counted),
cites AS (SELECT score_id, count(*) AS citations, count(*) FILTER (n IS NULL) AS fabricated, count(*) FILTER (n > 1) AS unresolved_citations, count(*) FILTER (n = 1) AS confirmed
  FROM (SELECT DISTINCT citation_id, score_id FROM citations) LEFT JOIN (SELECT citation_id, count(*) AS n FROM registry_candidates GROUP BY 1) USING (citation_id) GROUP BY score_id),
scores AS (SELECT t.task_id, t.model, t.run_id, s.*, c.citations, c.fabricated, c.unresolved_citations, c.confirmed FROM task_scores t JOIN scored s USING (score_id) LEFT JOIN cites c USING (score_id))
"""
_done = "FILTER (status = 'complete')"
BATCH = f"""count(*) AS n_tasks, count(*) {_done} AS n_complete, count(*) FILTER (status <> 'complete') AS n_incomplete, count(*) FILTER (status = 'complete' AND all_pass) AS n_allpass,
{RATE("count(*) FILTER (status = 'complete' AND all_pass)", f"count(*) {_done}")} AS allpass_rate, {RATE(f"sum(n_required_passed) {_done}", f"sum(n_required) {_done}")} AS required_criterion_pass_rate,
{SAFE(f"sum(n_bonus_passed) {_done}", f"(sum(n_bonus) {_done} - sum(n_bonus_unresolved) {_done})")} AS bonus_pass_rate, {RATE("sum(n_unresolved)", "sum(n_criteria)")} AS unresolved_rate,
CAST(sum(n_unresolved) AS BIGINT) AS n_unresolved, CAST(sum(n_criteria) AS BIGINT) AS criteria_evaluated, count(*) FILTER (coalesce(citations, 0) > 0) AS tasks_with_citations, count(*) FILTER (coalesce(citations, 0) = 0) AS citation_not_cited_tasks,
CAST(coalesce(sum(citations), 0) AS BIGINT) AS citations_extracted_total, CAST(coalesce(sum(fabricated), 0) AS BIGINT) AS citations_fabricated_total, CAST(coalesce(sum(unresolved_citations), 0) AS BIGINT) AS citations_unresolved_total, CAST(coalesce(sum(confirmed), 0) AS BIGINT) AS citations_confirmed_total,
{RATE("sum(fabricated)", "sum(citations)")} AS citation_fabrication_rate, {RATE("sum(unresolved_citations)", "sum(citations)")} AS unresolved_verification_rate, {RATE("count(*) FILTER (coalesce(citations, 0) = 0)", "count(*)")} AS citation_nc_rate"""
FALSE = SCORED + f""", fp AS (SELECT a.score_id, a.model, {area_sql('b.macro_area')} AS area, s.n_criteria AS n, s.n_passed AS p, s.n_unresolved AS u, trim(coalesce(a.model_output, ''), E' \\t\\n\\r\\u00a0') = '' AS blank
  FROM task_scores a JOIN benchmark_tasks b USING (task_id) LEFT JOIN counted s USING (score_id) WHERE b.task_type = 'bullshit'),
fps AS (SELECT *, CASE WHEN blank THEN 'fail' WHEN n IS NULL OR u > 0 THEN 'unresolved' WHEN p = n THEN 'pass' ELSE 'fail' END AS verdict FROM fp)
"""
KIND = "CASE WHEN coalesce(b.task_type, '') = 'bullshit' OR starts_with(t.task_id, 'bullshit/') THEN 'bullshit' ELSE coalesce(nullif(b.task_type, ''), 'standard') END"
FRAME = SCORED + f""", frame AS (SELECT t.score_id, t.run_id, t.task_id, t.model, t.score, t.all_pass, t.scoring_status, split_part(t.run_id, '/', 2) AS run_timestamp, t.model || ' · ' || split_part(t.run_id, '/', 2) AS series_label,
  {KIND} AS task_kind, {KIND} <> 'bullshit' AS standard, CASE WHEN coalesce(b.macro_area, '') <> '' THEN {area_sql('b.macro_area')} ELSE {area_sql("split_part(t.task_id, '/', 1)")} END AS macro_area, {KIND} <> 'bullshit' AS citation_applicable,
  CASE WHEN coalesce(c.citations, 0) = 0 THEN 'nc' WHEN c.fabricated > 0 THEN 'fail' ELSE 'pass' END AS citation_verdict, CASE WHEN coalesce(c.citations, 0) = 0 THEN 'not_cited' ELSE 'complete' END AS citation_status,
  round(c.confirmed / nullif(c.citations, 0), 6) AS citation_score, CASE t.score WHEN 1.0 THEN 'pass' WHEN 0.0 THEN 'fail' ELSE 'unresolved' END AS verdict, c.citations, c.fabricated
  FROM task_scores t LEFT JOIN benchmark_tasks b USING (task_id) LEFT JOIN cites c USING (score_id)),
tasks AS (SELECT * FROM frame QUALIFY row_number() OVER (PARTITION BY run_id, model, task_id ORDER BY score_id) = 1),
crit AS (SELECT k.run_id, k.model, k.task_id, k.macro_area, k.standard, k.scoring_status, r.criterion_id, r.title, r.verdict FROM criterion_results r JOIN tasks k USING (score_id) QUALIFY row_number() OVER (PARTITION BY k.run_id, k.model, k.task_id, r.criterion_id ORDER BY score_id) = 1)
"""
_app, _cit = "citation_applicable", "citation_applicable AND citation_status = 'complete'"
TASK_RATES = f"""count(*) AS n_standard_tasks, count(*) FILTER (scoring_status = 'complete') AS n_complete, count(*) FILTER (scoring_status IS DISTINCT FROM 'complete') AS n_incomplete,
{SAFE("count(*) FILTER (scoring_status = 'complete' AND all_pass)", "count(*) FILTER (scoring_status = 'complete')")} AS all_pass_rate, count(*) FILTER ({_app}) AS n_citation_applicable, count(*) FILTER ({_cit}) AS n_citation_complete,
{SAFE(f"count(*) FILTER ({_cit})", f"count(*) FILTER ({_app})")} AS citation_coverage, round(avg(citation_score) FILTER ({_cit}), 6) AS mean_citation_score, {SAFE(f"count(*) FILTER ({_cit} AND citation_score = 1.0)", f"count(*) FILTER ({_cit})")} AS citation_perfect_rate,
{SAFE(f"count(*) FILTER ({_app} AND citation_verdict = 'nc')", f"count(*) FILTER ({_app})")} AS citation_nc_rate, {SAFE(f"sum(fabricated) FILTER ({_cit})", f"sum(citations) FILTER ({_cit})")} AS fabrication_rate"""


def _board(keys: str) -> str:
    return f"""SELECT * FROM (SELECT {keys}, {TASK_RATES} FROM tasks WHERE standard GROUP BY {keys}) LEFT JOIN (SELECT {keys.replace(', run_timestamp', '')},
{SAFE("count(*) FILTER (verdict = 'pass')", "count(*) FILTER (verdict IN ('pass', 'fail'))")} AS criterion_pass_rate, {SAFE("count(*) FILTER (verdict IN ('pass', 'fail'))", "count(*)")} AS criterion_resolution_coverage
FROM crit WHERE standard AND scoring_status = 'complete' GROUP BY ALL) USING ({keys.replace(', run_timestamp', '')})"""


ORACLE = {
    "task_scores_derived": SCORED + """SELECT *, concat_ws(' ', format('Reasoning: {}/{} criteri required superati.', n_required_passed, n_required), CASE WHEN n_bonus > 0 THEN format('Bonus: {}/{} ottenuti.', n_bonus_passed, n_bonus) END,
CASE WHEN status = 'incomplete' THEN format('VALUTAZIONE INCOMPLETA: {} required unresolved.', n_required_unresolved) END) AS reasoning FROM scored""",
    "score_differences": SCORED + "SELECT t.scoring_status, t.all_pass, s.status, s.all_pass AS derived, count(*) AS n FROM task_scores t LEFT JOIN scored s USING (score_id) GROUP BY ALL",
    "batch_summary": SCORED + f"SELECT {BATCH} FROM scores",
    "summary_by_area": SCORED + f"SELECT CASE WHEN contains(task_id, '/') THEN split_part(task_id, '/', 1) ELSE 'unknown' END AS area, {BATCH} FROM scores GROUP BY 1",
    "summary_by_model": SCORED + f"SELECT model, {BATCH} FROM scores GROUP BY 1",
    "tasks_answers": f"SELECT t.model, {area_sql('b.macro_area')} AS area, count(*) AS answers, count(DISTINCT task_id) AS tasks, CAST(sum(len(b.criteria)) AS BIGINT) AS criteria FROM task_scores t JOIN benchmark_tasks b USING (task_id) GROUP BY ALL",
    "tasks_unmatched": "SELECT score_id, task_id FROM task_scores WHERE task_id NOT IN (SELECT task_id FROM benchmark_tasks WHERE task_type = 'standard')",
    "false_premise_scores": FALSE + f"SELECT score_id, verdict, CASE verdict WHEN 'pass' THEN 1.0::DOUBLE WHEN 'fail' THEN 0.0::DOUBLE END AS score, {SAFE('p', 'n - u')} AS pass_rate FROM fps",
    "false_premise_summary": FALSE + f"""SELECT area, model, concat_ws('+', CASE WHEN grouping(area) = 0 THEN 'area' END, CASE WHEN grouping(model) = 0 THEN 'model' END) AS level, count(*) AS n, count(*) FILTER (verdict <> 'unresolved') AS complete, count(*) FILTER (verdict = 'pass') AS passed,
{SAFE("count(*) FILTER (verdict = 'pass')", "count(*) FILTER (verdict <> 'unresolved')")} AS detection_rate, {SAFE("count(*) FILTER (verdict = 'unresolved')", "count(*)")} AS unresolved_rate FROM fps GROUP BY GROUPING SETS ((), (area), (model))""",
    "task_rows": FRAME + "SELECT score_id, run_timestamp, series_label, task_kind, standard, macro_area, citation_applicable, citation_verdict, citation_status, citation_score FROM frame",
    "keep_first_dedup": FRAME + "SELECT run_id, model, task_id, score_id FROM tasks",
    "leaderboard": FRAME + f"SELECT *, row_number() OVER (ORDER BY all_pass_rate DESC NULLS LAST, criterion_pass_rate DESC NULLS LAST, mean_citation_score DESC NULLS LAST, run_id, model) AS position FROM ({_board('run_id, model, run_timestamp')})",
    "metrics_by_area": FRAME + _board("run_id, model, macro_area"),
    "false_premise_leaderboard": FRAME + f"""SELECT run_id, model, count(*) AS n, count(*) FILTER (coalesce(scoring_status, 'complete') = 'complete') AS n_complete,
{SAFE("count(*) FILTER (coalesce(scoring_status, 'complete') = 'complete' AND verdict = 'pass')", "count(*) FILTER (coalesce(scoring_status, 'complete') = 'complete')")} AS detection_rate,
{SAFE("count(*) FILTER (verdict = 'unresolved' OR scoring_status = 'incomplete')", "count(*)")} AS unresolved_rate FROM tasks WHERE NOT standard GROUP BY run_id, model""",
    "status_distribution": FRAME + """, b AS (SELECT model, CASE WHEN citation_verdict = 'nc' THEN 'nc' WHEN scoring_status = 'incomplete' THEN 'incomplete' WHEN citation_verdict = 'fail' THEN 'unresolved' ELSE 'complete' END AS k FROM tasks)
SELECT model, count(*) AS n, """ + ", ".join(f"round(count(*) FILTER (k = '{k}') / count(*), 6) AS {k}" for k in ("complete", "incomplete", "nc", "unresolved")) + " FROM b GROUP BY model",
    "criterion_heatmap": FRAME + "SELECT macro_area, title, model, round(avg((verdict = 'pass')::INT), 6) AS pass_rate, count(*) AS n FROM crit GROUP BY ALL",
    "run_log": FRAME + "SELECT model, count(*) AS tasks, count(DISTINCT task_id) AS distinct_tasks, count(DISTINCT run_id) AS runs, count(*) FILTER (standard) AS standard FROM tasks GROUP BY model",
    "latest_runs": f"""WITH p AS (SELECT DISTINCT CASE WHEN {KIND} = 'bullshit' THEN 'bullshit' ELSE 'standard' END AS family, run_id FROM task_scores t LEFT JOIN benchmark_tasks b USING (task_id))
SELECT family, split_part(run_id, '/', 1) AS model, split_part(run_id, '/', 2) AS run_timestamp, CASE WHEN family = 'bullshit' THEN 'bullshit/' ELSE '' END || run_id || '/scores.json' AS path, run_id FROM p
QUALIFY row_number() OVER (PARTITION BY family, split_part(run_id, '/', 1) ORDER BY split_part(run_id, '/', 2) DESC) = 1""",
    "runs_since": "SELECT run_id, model, count(*) AS scores FROM task_scores WHERE split_part(run_id, '/', 2) >= '20240601' AND model IN ('aquila-mini', 'etna-pro') GROUP BY ALL",
    "task_ids": f"SELECT task_id, area || '/' || format('{{:04d}}', row_number() OVER (PARTITION BY area ORDER BY created_at, task_id)) AS new_id FROM (SELECT task_id, created_at, {area_sql('macro_area')} AS area FROM benchmark_tasks)",
}
