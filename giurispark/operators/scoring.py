"""Scores of answers: joins with tasks, counters, verdicts and batch summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(n: Column, d: Column) -> Column:
    """Share, 0 where nothing counts."""
    return F.round(F.coalesce(F.try_divide(n, d), F.lit(0.0)), 6)


def safe_rate(n: Column, d: Column) -> Column:
    """Share, null where nothing counts."""
    return F.round(F.try_divide(n, d), 6)


def answered(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """Tasks with their answers; answers to unknown tasks are left out."""
    return answers.join(tasks, "task_id")


def unmatched(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    return answers.join(tasks.select("task_id"), "task_id", "left_anti")


def counters(criteria: DataFrame) -> DataFrame:
    """Per score: criteria passed and unresolved, in all and by kind."""
    passed, unresolved = F.col("verdict") == "pass", F.col("verdict") == "unresolved"
    required, bonus = F.col("scoring_type") == "required", F.col("scoring_type") == "bonus"
    return criteria.groupBy("score_id").agg(
        F.count("*").alias("n_criteria"), F.count_if(passed).alias("n_passed"), F.count_if(unresolved).alias("n_unresolved"),
        F.count_if(required).alias("n_required"), F.count_if(required & passed).alias("n_required_passed"), F.count_if(required & unresolved).alias("n_required_unresolved"),
        F.count_if(bonus).alias("n_bonus"), F.count_if(bonus & passed).alias("n_bonus_passed"), F.count_if(bonus & unresolved).alias("n_bonus_unresolved"),
    )


def verdicts(counted: DataFrame) -> DataFrame:
    """Status, all-pass, score and rates; an unresolved required criterion leaves the score open."""
    open_ = F.col("n_required_unresolved") > 0
    all_pass = (F.col("n_required") > 0) & (F.col("n_required_passed") == F.col("n_required"))
    return counted.withColumns({
        "status": F.when(open_, "incomplete").otherwise("complete"),
        "all_pass": F.when(~open_, all_pass),
        "score": F.when(~open_, F.when(all_pass, 1.0).otherwise(0.0)),
        "required_pass_rate": F.when(~open_, rate(F.col("n_required_passed"), F.col("n_required"))),
        "bonus_pass_rate": safe_rate(F.col("n_bonus_passed"), F.col("n_bonus") - F.col("n_bonus_unresolved")),
        "unresolved_rate": rate(F.col("n_unresolved"), F.col("n_criteria")),
    })


def sentence(scored: DataFrame) -> Column:
    """The score in words."""
    return F.concat_ws(
        " ",
        F.format_string("Reasoning: %d/%d criteri required superati.", "n_required_passed", "n_required"),
        F.when(F.col("n_bonus") > 0, F.format_string("Bonus: %d/%d ottenuti.", "n_bonus_passed", "n_bonus")),
        F.when(F.col("status") == "incomplete", F.format_string("VALUTAZIONE INCOMPLETA: %d required unresolved.", "n_required_unresolved")),
    )


def batch_aggregates() -> list[Column]:
    """Aggregates of a batch; open scores do not enter the primary denominators. Expects the columns of verdicts and citation counts."""
    done = F.col("status") == "complete"
    part = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    cited = F.coalesce("citations", F.lit(0)) > 0
    return [
        F.count("*").alias("n_tasks"), F.count_if(done).alias("n_complete"), F.count_if(~done).alias("n_incomplete"), F.count_if(done & F.col("all_pass")).alias("n_allpass"),
        rate(F.count_if(done & F.col("all_pass")), F.count_if(done)).alias("allpass_rate"),
        rate(part("n_required_passed"), part("n_required")).alias("required_criterion_pass_rate"),
        safe_rate(part("n_bonus_passed"), part("n_bonus") - part("n_bonus_unresolved")).alias("bonus_pass_rate"),
        rate(total("n_unresolved"), total("n_criteria")).alias("unresolved_rate"), total("n_unresolved").alias("n_unresolved"), total("n_criteria").alias("criteria_evaluated"),
        F.count_if(cited).alias("tasks_with_citations"), F.count_if(~cited).alias("citation_not_cited_tasks"), total("citations").alias("citations_extracted_total"),
        total("fabricated").alias("citations_fabricated_total"), total("unresolved_citations").alias("citations_unresolved_total"), total("confirmed").alias("citations_confirmed_total"),
        rate(total("fabricated"), total("citations")).alias("citation_fabrication_rate"), rate(total("unresolved_citations"), total("citations")).alias("unresolved_verification_rate"),
        rate(F.count_if(~cited), F.count("*")).alias("citation_nc_rate"),
    ]


def summary(scores: DataFrame) -> DataFrame:
    return scores.agg(*batch_aggregates())


def summary_by_area(scores: DataFrame) -> DataFrame:
    """By the raw prefix of the task id."""
    raw = F.when(F.contains("task_id", F.lit("/")), F.substring_index("task_id", "/", 1)).otherwise("unknown")
    return scores.groupBy(raw.alias("area")).agg(*batch_aggregates())


def false_premise(answers: DataFrame, criteria: DataFrame) -> DataFrame:
    """Scores of false-premise tasks: a blank answer fails; an unresolved criterion leaves the score open."""
    counted = criteria.groupBy("score_id").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "pass").alias("p"), F.count_if(F.col("verdict") == "unresolved").alias("u"))
    blank = F.coalesce(F.regexp_replace("model_output", r"(?U)\s", ""), F.lit("")) == ""
    joined = answers.join(counted, "score_id", "left")
    verdict = F.when(blank, "fail").when(F.col("n").isNull() | (F.col("u") > 0), "unresolved").when(F.col("p") == F.col("n"), "pass").otherwise("fail")
    return joined.withColumn("verdict", verdict).withColumns({
        "score": F.when(F.col("verdict") == "pass", 1.0).when(F.col("verdict") == "fail", 0.0), "pass_rate": safe_rate(F.col("p"), F.col("n") - F.col("u")),
    })


def false_premise_summary(scored: DataFrame, *keys: str) -> DataFrame:
    """Overall and by each key in one pass over grouping sets."""
    sets = [[], *[[k] for k in keys]]
    cols = [F.col(k) for k in keys]
    done = F.col("verdict") != "unresolved"
    level = F.concat_ws("+", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys])
    return scored.groupingSets([[F.col(k) for k in s] for s in sets], *cols).agg(
        level.alias("level"), F.count("*").alias("n"), F.count_if(done).alias("complete"), F.count_if(F.col("verdict") == "pass").alias("passed"),
        safe_rate(F.count_if(F.col("verdict") == "pass"), F.count_if(done)).alias("detection_rate"), safe_rate(F.count_if(~done), F.count("*")).alias("unresolved_rate"),
    )


# ---- citation side of a score -----------------------------------------------------------------


def citation_scores(grounded: DataFrame, gold: DataFrame) -> DataFrame:
    """One row per score with citations: what was extracted, relevant, outside the profile, invented or open, and the shares of it.

    grounded: score_id, task_id, matched, final_status, relation; gold: task_id, required, acceptable (sizes of the task's profile).
    Coverage is the share of required sources that are cited, relevance the share of the verifiable citations that the
    profile knows, the score their mean; each is null where its denominator is 0.
    """
    rel = lambda r: F.count_if(F.col("relation") == r)
    per = grounded.groupBy("score_id", "task_id").agg(
        F.count("*").alias("citations_extracted_count"), (rel("issue_aligned") + rel("retrieved_only")).alias("citations_relevant_count"), rel("outside_profile").alias("citations_outside_gold_count"),
        rel("fabricated_or_not_found").alias("citations_fabricated_count"), rel("unresolved").alias("citations_unresolved_count"),
        F.countDistinct(F.when(F.col("relation") == "issue_aligned", F.col("matched"))).alias("required_hit"), F.countDistinct(F.when(F.col("relation") == "retrieved_only", F.col("matched"))).alias("citation_acceptable_matched_count"),
        F.count_if(F.col("final_status").isin("resolved_local_registry_exact", "resolved_local_registry_incomplete", "resolved_local_registry_metadata_mismatch", "ambiguous_local_registry")).alias("existence_confirmed_count"),
        F.count_if(F.col("final_status").isin("not_found_in_index", "resolver_error", "citation_extraction_error")).alias("existence_unresolved_count"),
        F.count_if(F.col("final_status") == "citation_extraction_error").alias("citation_extraction_error_count"),
    )
    return per.join(gold, "task_id", "left")


def scored_citations(scores: DataFrame) -> DataFrame:
    """Scores (left-joined with citation_scores) with their citation status, verdict and shares; a score without citations is not cited, a false-premise task has none to judge."""
    zero = {c: F.coalesce(c, F.lit(0)) for c in (
        "citations_extracted_count", "citations_relevant_count", "citations_outside_gold_count", "citations_fabricated_count", "citations_unresolved_count", "required_hit", "citation_acceptable_matched_count",
        "existence_confirmed_count", "existence_unresolved_count", "citation_extraction_error_count", "required", "acceptable",
    )}
    df = scores.withColumns(zero).withColumnsRenamed({"required": "citation_required_count", "acceptable": "citation_acceptable_count"})
    n, fake, open_ = F.col("citations_extracted_count"), F.col("citations_fabricated_count"), F.col("citations_unresolved_count")
    df = df.withColumns({
        "citation_required_matched_count": F.least("required_hit", "citation_required_count"), "citations_evaluable_count": n - fake - open_, "citation_fabrication_rate": F.round(F.try_divide(fake, n), 6),
    }).drop("required_hit")
    df = df.withColumns({"citation_coverage_score": F.round(F.try_divide("citation_required_matched_count", "citation_required_count"), 6), "citation_relevance_score": F.round(F.try_divide("citations_relevant_count", "citations_evaluable_count"), 6)})
    status = F.when(~F.col("standard"), "not_applicable").when(n == 0, "not_cited").when(F.col("citations_evaluable_count") + fake == 0, "incomplete").otherwise("complete")
    df = df.withColumns({
        "citation_score": F.round((F.coalesce("citation_coverage_score", "citation_relevance_score") + F.coalesce("citation_relevance_score", "citation_coverage_score")) / 2, 6), "citation_scoring_status": status, "citation_hard_fail": fake > 0,
    })
    full = F.coalesce(F.col("citation_coverage_score"), F.lit(1.0)) == 1.0
    verdict = F.when(F.col("citation_scoring_status") == "not_applicable", "not_applicable").when(F.col("citation_scoring_status") == "not_cited", "nc").when(F.col("citation_scoring_status") == "incomplete", "unresolved").when(full & (fake == 0), "pass").otherwise("fail")
    return df.withColumns({"citation_verdict": verdict, "citation_applicable": F.col("standard")})


def batch_metrics() -> list[Column]:
    """Every metric of a batch over scored_citations with verdicts, methods (n_initial_agreement ...) and calls (calls_a ...); citation metrics over scores that citations apply to."""
    app = F.col("citation_applicable")
    cited = app & (F.col("citation_scoring_status") == "complete")
    total = lambda c, of=None: F.coalesce(F.sum(F.when(of, F.col(c)) if of is not None else F.col(c)), F.lit(0))
    is_ = lambda v, of=app: F.count_if(of & (F.col("citation_verdict") == v))
    mean = lambda c: F.round(F.avg(F.when(cited, F.col(c))), 6)
    perfect, valued = F.count_if(cited & (F.col("citation_score") == 1.0)), F.count(F.when(cited, F.col("citation_score")))
    n_app, n_cited, done = F.count_if(app), F.count_if(cited), F.col("status") == "complete"
    fake, evaluable = total("citations_fabricated_count", app), total("citations_evaluable_count", app)
    kept = [c for c in batch_aggregates() if _name(c) in ("n_tasks", "n_complete", "n_incomplete", "n_allpass", "allpass_rate", "required_criterion_pass_rate", "bonus_pass_rate", "unresolved_rate", "n_unresolved", "criteria_evaluated")]
    return [
        *kept, rate(F.count_if(done & F.col("all_pass")), F.count_if(done)).alias("reasoning_allpass_rate"),
        *[total(f"calls_{j}").alias(f"judge_calls_{j}") for j in "abc"],
        total("n_initial_agreement").alias("initial_agreements"), total("n_tie_breaker").alias("tie_breakers"), total("n_recovery_agreement").alias("recoveries"), total("n_method_unresolved").alias("unresolved_criteria"), total("calls_c").alias("judge_c_evaluated_criteria"),
        n_cited.alias("citation_complete_tasks"), is_("unresolved").alias("citation_incomplete_tasks"), F.count_if(app & (F.col("existence_unresolved_count") > 0) & (F.col("existence_confirmed_count") == 0)).alias("citation_existence_unresolved_tasks"),
        is_("nc").alias("citation_not_cited_tasks"), F.count_if(~app).alias("citation_not_applicable_tasks"), is_("pass", cited).alias("citation_pass_tasks"), is_("fail", cited).alias("citation_fail_tasks"), perfect.alias("citation_perfect_tasks"),
        rate(perfect, valued).alias("citation_perfect_rate"), mean("citation_score").alias("citation_mean_score"), mean("citation_coverage_score").alias("citation_mean_coverage_score"), mean("citation_relevance_score").alias("citation_mean_relevance_score"),
        rate(is_("pass", cited), is_("pass", cited) + is_("fail", cited)).alias("citation_all_pass_rate"), rate(is_("pass", cited), n_cited).alias("citation_pass_rate"), rate(is_("fail", cited), n_cited).alias("citation_fail_rate"),
        rate(is_("nc"), n_app).alias("citation_nc_rate"), rate(is_("unresolved"), n_app).alias("citation_unresolved_rate"), rate(n_cited, n_app).alias("citation_complete_coverage"), rate(n_cited, n_app).alias("citation_scoring_coverage"),
        total("citation_required_count", app).alias("citation_required_total"), total("citation_required_matched_count", app).alias("citation_required_matched_total"),
        (total("citation_required_count", app) - total("citation_required_matched_count", app)).alias("citation_required_missing_total"), F.coalesce(F.sum(F.when(app & (F.col("citation_scoring_status") == "incomplete"), F.col("citation_required_count"))), F.lit(0)).alias("citation_required_unresolved_total"),
        rate(total("citation_required_matched_count", app), total("citation_required_count", app)).alias("required_citation_coverage_rate"),
        F.count_if(cited & (F.col("citation_coverage_score") == 1.0)).alias("citation_minimum_complete_tasks"), F.count_if(cited & (F.col("citation_coverage_score") < 1.0)).alias("citation_minimum_incomplete_tasks"),
        rate(total("citations_relevant_count", app), evaluable).alias("citation_relevant_rate"), F.count_if(app & (F.col("citations_outside_gold_count") > 0)).alias("citation_outside_gold_tasks"),
        rate(fake, evaluable + fake).alias("citation_fabrication_rate"), rate(fake, evaluable + fake).alias("confirmed_fabrication_rate"), rate(total("existence_unresolved_count", app), evaluable).alias("unresolved_verification_rate"),
        F.count_if(app & (F.col("citations_extracted_count") > 0)).alias("tasks_with_citations"), (total("citation_required_count", app) + total("citation_acceptable_count", app)).alias("citation_gold_total"),
        total("citations_extracted_count", app).alias("citations_extracted_total"), (total("citation_required_matched_count", app) + total("citation_acceptable_matched_count", app)).alias("citations_matched_gold_total"),
        total("citations_relevant_count", app).alias("citations_relevant_total"), evaluable.alias("citations_evaluable_total"), total("citations_outside_gold_count", app).alias("citations_outside_gold_total"), fake.alias("citations_fabricated_total"),
        total("citations_unresolved_count", app).alias("citations_unresolved_total"), total("citation_extraction_error_count", app).alias("citation_extraction_error_total"), F.count_if(app & (F.col("citation_extraction_error_count") > 0)).alias("citation_extraction_error_tasks"),
    ]


def _name(column: Column) -> str:
    return column._jc.toString().rsplit(" AS ", 1)[-1].strip("`")


def greatest_counts(recounted: DataFrame, reported: DataFrame, key: str, statuses: tuple[str, ...]) -> DataFrame:
    """Per key the counts of each status: the greater of what is recounted (one column a status) and what a report says; a side without the key counts 0."""
    r = reported.select(key, *[F.col(s).alias(f"_{s}") for s in statuses])
    return recounted.join(r, key, "full").select(key, *[F.greatest(F.coalesce(s, F.lit(0)), F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in statuses])


def panel_of_tasks(tasks: DataFrame, answers: DataFrame, criteria: DataFrame) -> DataFrame:
    """Every false-premise task with its score, whether answered or not: a missing or blank answer fails with 0.

    tasks: task_id and what is kept of it; answers: task_id, score_id, model_output (one row for each task, or none); criteria: score_id, verdict.
    """
    return false_premise(tasks.join(answers, "task_id", "left"), criteria)


def panel_diagnostics(criteria: DataFrame, calls: DataFrame, *keys: str) -> DataFrame:
    """Methods and judge calls of the panel per key. criteria: keys, method (null: single); calls: keys, judge."""
    method = F.coalesce("method", F.lit("single"))
    methods = criteria.groupBy(*keys).agg(
        F.count("*").alias("criteria_evaluated"), *[F.count_if(method == m).alias(a) for m, a in (("initial_agreement", "initial_agreements"), ("tie_breaker", "tie_breakers"), ("recovery_agreement", "recoveries"), ("unresolved", "unresolved_criteria"))]
    )
    used = calls.groupBy(*keys).agg(*[F.count_if(F.col("judge") == j).alias(f"calls_{j.lower()}") for j in "ABC"], (F.count_if(F.col("judge") == "C") > 0).alias("judge_c_used"))
    return methods.join(used, list(keys), "left")
