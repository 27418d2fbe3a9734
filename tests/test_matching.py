import pytest
from pyspark.sql import functions as F

from giurispark.functions import text
from giurispark.operators import consensus, matching, scoring


def test_samples_and_areas(spark):
    tasks = spark.createDataFrame([(f"a/{i}", "Civile") for i in range(5)] + [("Diritto_X/1", None)], "task_id string, macro_area string")
    assert [r.task_id for r in matching.sampled_sorted(tasks, "task_id", 0, 1).collect()] == sorted(r.task_id for r in tasks.collect())
    assert matching.sampled_sorted(tasks, "task_id", 3, 1).count() == 3
    with pytest.raises(ValueError):
        matching.sampled_sorted(tasks, "task_id", 0, 1, strict=True)
    assert matching.of_area(tasks, "CIVILE").count() == 5 and [r.task_id for r in matching.of_area(tasks, "diritto_x").collect()] == ["Diritto_X/1"]
    assert [f.count() for f in matching.of_areas([tasks, tasks], ["Civile"])] == [5, 5]
    with pytest.raises(ValueError):
        matching.of_areas([tasks], ["none"])


def test_criteria_and_decisions_from_replies(spark):
    reply = '```json\n[{"title": " A ", "match_criteria": "x"}, {"title": "", "match_criteria": "y"}, {"title": "B", "match_criteria": "z"}]\n```'
    df = spark.createDataFrame([(reply,), ("no list",), (None,)], "r string")
    got = [r[0] for r in df.select(matching.parsed_criteria(F.col("r"))).collect()]
    assert [tuple(c) for c in got[0]] == [("C-001", "A", "x"), ("C-002", "B", "z")] and got[1:] == [None, None]
    votes = spark.createDataFrame([('Ecco: {"verdict": " PASS ", "reasoning": "sì"}',), ('{"verdict": "forse"}',), ("nulla",), (None,)], "r string").select(*[v.alias(k) for k, v in consensus.coerced(F.col("r")).items()]).collect()
    assert [(v.decision, v.decision_status, v.decision_reasoning) for v in votes] == [("pass", "ok", "sì"), (None, "error", None), (None, "error", None), (None, "error", None)]


def test_panel_keeps_unanswered_tasks(spark):
    tasks = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "task_id string")
    answers = spark.createDataFrame([("t1", 1, "Sì."), ("t2", 2, "  ")], "task_id string, score_id long, model_output string")
    criteria = spark.createDataFrame([(1, "pass"), (1, "pass"), (2, "pass")], "score_id long, verdict string")
    assert {r.task_id: (r.verdict, r.score) for r in scoring.panel_of_tasks(tasks, answers, criteria).collect()} == {"t1": ("pass", 1.0), "t2": ("fail", 0.0), "t3": ("fail", 0.0)}


def test_missing_votes_are_errors(spark):
    criteria = spark.createDataFrame([(1, "a"), (1, "b")], "s long, c string")
    votes = spark.createDataFrame([(1, "a", "A", "pass", "ok", True), (1, "a", "B", "", "error", False)], "s long, c string, judge string, verdict string, status string, valid boolean")
    got = {(r.c, r.judge): (r.verdict, r.status) for r in consensus.completed(criteria, votes, ["s", "c"]).collect()}
    assert got == {("a", "A"): ("pass", "ok"), ("a", "B"): (None, "error"), ("b", "A"): (None, "missing"), ("b", "B"): (None, "missing")}
    adapted = consensus.adapted(criteria, spark.createDataFrame([(1, "a", "pass")], "s long, c string, verdict string"), ["s", "c"], "fail")
    assert {r.c: r.verdict for r in adapted.collect()} == {"a": "pass", "b": "fail"}


def test_export_header(spark):
    rows = spark.createDataFrame([("[03/12/2024, 10:15] - Ciao",), ("Ciao 03/12/2024",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.without_export_header(F.col("t"))).collect()] == ["Ciao", "Ciao 03/12/2024", None]
