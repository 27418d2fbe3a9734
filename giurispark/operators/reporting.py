"""Reports over runs: frames, latest runs, leaderboards, metrics by area, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from giurispark.functions import text
from giurispark.operators.ranking import numbered
from giurispark.operators.scoring import safe_rate

RUN = ["run_id", "model", "series_label"]


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order (a plain dropDuplicates would take any)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def citation_applicable(task_kind: Column, verdict: Column, status: Column) -> Column:
    """True unless not applicable; a missing verdict or status is no reason."""
    return (task_kind != "bullshit") & ~verdict.eqNullSafe(F.lit("not_applicable")) & ~status.eqNullSafe(F.lit("not_applicable"))


def task_frame(scores: DataFrame) -> DataFrame:
    """One row per score with derived columns.

    scores: score_id, run_id, task_id, task_type, macro_area, model, score, all_pass, scoring_status, citation_verdict,
    citation_status, citation_score, citations, fabricated.
    """
    stamp = F.when(F.contains("run_id", F.lit("/")), F.substring_index("run_id", "/", -1)).otherwise("")
    kind = text.task_kind(F.col("task_type"), F.col("task_id"))
    return scores.withColumns({
        "run_timestamp": stamp, "series_label": text.series_label(F.col("model"), stamp), "task_kind": kind, "standard": kind != "bullshit",
        "macro_area": F.when(F.length(F.coalesce("macro_area", F.lit(""))) > 0, text.area(F.col("macro_area"))).otherwise(text.area_of_task(F.col("task_id"))),
        "citation_applicable": citation_applicable(kind, F.col("citation_verdict"), F.col("citation_status")),
    })


def first_tasks(frame: DataFrame) -> DataFrame:
    return keep_first(frame, ["run_id", "model", "task_id"], ["score_id"])


def criterion_frame(tasks: DataFrame, criteria: DataFrame) -> DataFrame:
    """Criteria with the keys of their score, first of each key."""
    keys = tasks.select("score_id", "run_id", "model", "series_label", "task_id", "macro_area", "standard", "scoring_status")
    return keep_first(criteria.join(keys, "score_id"), ["run_id", "model", "task_id", "criterion_id"], ["score_id"])


def _criteria_rates(criteria: DataFrame, keys: list[str]) -> DataFrame:
    resolved = F.col("verdict").isin("pass", "fail")
    return criteria.where("standard AND scoring_status = 'complete'").groupBy(*keys).agg(
        safe_rate(F.count_if(F.col("verdict") == "pass"), F.count_if(resolved)).alias("criterion_pass_rate"), safe_rate(F.count_if(resolved), F.count("*")).alias("criterion_resolution_coverage")
    )


def _task_rates() -> list[Column]:
    done, app = F.col("scoring_status") == "complete", F.col("citation_applicable")
    cited = app & (F.col("citation_status") == "complete")
    return [
        F.count("*").alias("n_standard_tasks"), F.count_if(done).alias("n_complete"), (F.count("*") - F.count_if(done)).alias("n_incomplete"),
        safe_rate(F.count_if(done & F.col("all_pass")), F.count_if(done)).alias("all_pass_rate"),
        F.count_if(app).alias("n_citation_applicable"), F.count_if(cited).alias("n_citation_complete"), safe_rate(F.count_if(cited), F.count_if(app)).alias("citation_coverage"),
        F.round(F.avg(F.when(cited, F.col("citation_score"))), 6).alias("mean_citation_score"), safe_rate(F.count_if(cited & (F.col("citation_score") == 1.0)), F.count_if(cited)).alias("citation_perfect_rate"),
        safe_rate(F.count_if(app & (F.col("citation_verdict") == "nc")), F.count_if(app)).alias("citation_nc_rate"),
        safe_rate(F.coalesce(F.sum(F.when(cited, F.col("fabricated"))), F.lit(0)), F.coalesce(F.sum(F.when(cited, F.col("citations"))), F.lit(0))).alias("fabrication_rate"),
    ]


def leaderboard(tasks: DataFrame, criteria: DataFrame) -> DataFrame:
    """One row per run, two aggregates joined on its keys."""
    rows = tasks.where("standard").groupBy(*RUN, "run_timestamp").agg(*_task_rates())
    return rows.join(_criteria_rates(criteria, ["run_id", "model"]), ["run_id", "model"], "left")


def ranked(board: DataFrame) -> DataFrame:
    """Position in the leaderboard: three keys descending, nulls last, then the run."""
    order = [F.col(c).desc_nulls_last() for c in ("all_pass_rate", "criterion_pass_rate", "mean_citation_score")]
    return numbered(board, [], [*order, F.col("run_id").asc(), F.col("model").asc()])


def by_area(tasks: DataFrame, criteria: DataFrame) -> DataFrame:
    keys = [*RUN, "macro_area"]
    return tasks.where("standard").groupBy(*keys).agg(*_task_rates()).join(_criteria_rates(criteria, ["run_id", "model", "macro_area"]), ["run_id", "model", "macro_area"], "left")


def false_premise_board(tasks: DataFrame) -> DataFrame:
    """Runs on false-premise tasks; a missing status counts as complete."""
    done = F.coalesce("scoring_status", F.lit("complete")) == "complete"
    hit = F.coalesce(F.col("verdict") == "pass", F.lit(False)) | F.coalesce(F.col("score") == 1.0, F.lit(False))
    open_ = F.coalesce(F.col("verdict") == "unresolved", F.lit(False)) | F.coalesce(F.col("scoring_status") == "incomplete", F.lit(False))
    return tasks.where("NOT standard").groupBy(*RUN).agg(
        F.count("*").alias("n"), F.count_if(done).alias("n_complete"), safe_rate(F.count_if(done & hit), F.count_if(done)).alias("detection_rate"), safe_rate(F.count_if(open_), F.count("*")).alias("unresolved_rate")
    )


def status_distribution(tasks: DataFrame, statuses: tuple[str, ...] = ("complete", "incomplete", "nc", "unresolved")) -> DataFrame:
    """Share of each status per model: a pivot over fixed values, divided by its row."""
    counts = tasks.groupBy("model").pivot("bucket", list(statuses)).count().na.fill(0)
    total = sum((F.col(s) for s in statuses[1:]), F.col(statuses[0]))
    return counts.select("model", total.cast("long").alias("n"), *[F.round(F.try_divide(F.col(s), total), 6).alias(s) for s in statuses])


def heatmap(criteria: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of passes per criterion and model, long form."""
    return criteria.groupBy(*keys, "model").agg(F.round(F.avg((F.col("verdict") == "pass").cast("int")), 6).alias("pass_rate"), F.count("*").alias("n"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each model and family; of equal times the first path."""
    return keep_first(runs, ["model", "family"], [F.col("run_timestamp").desc(), "path"])
