"""Queries over judge votes and their consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from giurispark.operators import consensus
from giurispark.sources.tables import table

ITEM = ["score_id", "criterion_id"]


def _panels(spark: SparkSession, base: str) -> DataFrame:
    return consensus.panel(consensus.last_votes(table(spark, base, "judge_votes"), ITEM), ITEM)


def vote_validity(spark: SparkSession, base: str) -> DataFrame:
    """Votes by judge and what became of them."""
    votes = consensus.last_votes(table(spark, base, "judge_votes"), ITEM)
    return votes.groupBy("judge", "status", "valid").agg(F.count("*").alias("votes"))


def consensus_verdicts(spark: SparkSession, base: str) -> DataFrame:
    return consensus.decide(_panels(spark, base)).select(*ITEM, "verdict", "method", F.array_join("supporters", ",").alias("supporters"), "tie_breaker_used")


def consensus_single(spark: SparkSession, base: str) -> DataFrame:
    return consensus.single(_panels(spark, base)).select(*ITEM, "verdict", F.array_join("supporters", ",").alias("supporters"))


def consensus_diagnostics(spark: SparkSession, base: str) -> DataFrame:
    return consensus.diagnostics(consensus.decide(_panels(spark, base)))


def consensus_methods(spark: SparkSession, base: str) -> DataFrame:
    return consensus.decide(_panels(spark, base)).groupBy("method", "verdict").agg(F.count("*").alias("criteria"))


def vote_matrix(spark: SparkSession, base: str) -> DataFrame:
    return consensus.combination(_panels(spark, base)).groupBy("combination").agg(F.count("*").alias("criteria"))


def cohen_kappa(spark: SparkSession, base: str) -> DataFrame:
    return consensus.kappa(_panels(spark, base))


def kappa_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Agreement of every pair of judges."""
    panels = _panels(spark, base)
    out = None
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        row = consensus.kappa(panels, x, y).select(F.lit(f"{x}{y}".upper()).alias("judges"), "n", "kappa")
        out = row if out is None else out.unionByName(row)
    return out


def tie_breaker_calls(spark: SparkSession, base: str) -> DataFrame:
    return consensus.needs_c(_panels(spark, base), "score_id")


def recorded_against_derived(spark: SparkSession, base: str) -> DataFrame:
    """Recorded consensus against the one the votes give now."""
    derived = consensus.decide(_panels(spark, base)).select(*ITEM, F.col("verdict").alias("derived"), "method")
    recorded = table(spark, base, "criterion_results", *ITEM, "verdict", "consensus_method")
    return recorded.join(derived, ITEM, "left").groupBy(F.col("verdict").alias("recorded"), "consensus_method", "derived", "method").agg(F.count("*").alias("criteria"))


QUERIES = {f.__name__: f for f in (
    vote_validity, consensus_verdicts, consensus_single, consensus_diagnostics, consensus_methods, vote_matrix, cohen_kappa, kappa_pairs, tie_breaker_calls, recorded_against_derived,
)}

WS = "E' \\t\\n\\r'"
VOTES = f"""WITH shaped AS (SELECT score_id, criterion_id, upper(trim(judge_id, {WS})) AS judge, coalesce(lower(trim(verdict, {WS})), '') AS verdict, status, model, voted_at FROM judge_votes WHERE judge_id IS NOT NULL),
votes AS (SELECT *, status = 'ok' AND verdict IN ('pass', 'fail') AS valid FROM (SELECT * FROM shaped QUALIFY row_number() OVER (PARTITION BY score_id, criterion_id, judge ORDER BY voted_at DESC NULLS LAST, status DESC, verdict DESC, model DESC) = 1)),
panels AS (SELECT score_id, criterion_id,
  """ + ",\n  ".join(
    f"max(verdict) FILTER (judge = '{j}' AND valid) AS {j.lower()}, coalesce(max(CASE WHEN status <> 'ok' THEN 'error' ELSE verdict END) FILTER (judge = '{j}'), 'not_called') AS label_{j.lower()}" for j in "ABC"
) + """
  FROM votes GROUP BY ALL),
decided AS (SELECT *, CASE WHEN a = b THEN a WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN c WHEN (a IS NULL) <> (b IS NULL) AND c = coalesce(a, b) THEN c ELSE 'unresolved' END AS verdict,
  CASE WHEN a = b THEN 'initial_agreement' WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN 'tie_breaker' WHEN (a IS NULL) <> (b IS NULL) AND c = coalesce(a, b) THEN 'recovery_agreement' ELSE 'unresolved' END AS method FROM panels)
"""


def _kappa(x: str, y: str, extra: str = "") -> str:
    return f"""SELECT {extra}n, round(CASE WHEN n = 0 THEN NULL WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM (
SELECT n, same / nullif(n, 0) AS po, (px * py + (n - px) * (n - py)) / nullif(n * n, 0) AS pe FROM (
SELECT count(*) AS n, CAST(count(*) FILTER ({x} = {y}) AS DOUBLE) AS same, CAST(count(*) FILTER ({x} = 'pass') AS DOUBLE) AS px, CAST(count(*) FILTER ({y} = 'pass') AS DOUBLE) AS py FROM panels WHERE {x} IS NOT NULL AND {y} IS NOT NULL))"""


ORACLE = {
    "vote_validity": VOTES + "SELECT judge, status, valid, count(*) AS votes FROM votes GROUP BY ALL",
    "consensus_verdicts": VOTES + """SELECT score_id, criterion_id, verdict, method, method = 'tie_breaker' AS tie_breaker_used,
CASE method WHEN 'initial_agreement' THEN 'A,B' WHEN 'tie_breaker' THEN CASE WHEN a = c THEN 'A,C' ELSE 'B,C' END WHEN 'recovery_agreement' THEN CASE WHEN a IS NOT NULL THEN 'A,C' ELSE 'B,C' END ELSE '' END AS supporters FROM decided""",
    "consensus_single": VOTES + "SELECT score_id, criterion_id, coalesce(a, 'unresolved') AS verdict, CASE WHEN a IS NULL THEN '' ELSE 'A' END AS supporters FROM panels",
    "consensus_diagnostics": VOTES + """SELECT count(*) AS criteria_evaluated, round(avg((method = 'initial_agreement')::INT), 6) AS initial_agreement_rate, round(avg((method = 'tie_breaker')::INT), 6) AS tie_breaker_rate,
round(avg((method = 'recovery_agreement')::INT), 6) AS recovery_rate, round(avg((method = 'unresolved')::INT), 6) AS unresolved_rate,
""" + ", ".join(f"count(*) FILTER (label_{j} <> 'not_called') AS calls_{j}, round(coalesce(count(*) FILTER ({j} = 'pass') / nullif(count({j}), 0), 0), 6) AS pass_rate_{j}" for j in "abc") + " FROM decided",
    "consensus_methods": VOTES + "SELECT method, verdict, count(*) AS criteria FROM decided GROUP BY ALL",
    "vote_matrix": VOTES + "SELECT 'A:' || label_a || '|B:' || label_b || '|C:' || label_c AS combination, count(*) AS criteria FROM panels GROUP BY ALL",
    "cohen_kappa": VOTES + _kappa("a", "b"),
    "kappa_pairs": VOTES + " UNION ALL ".join(_kappa(x, y, f"'{x}{y}'".upper() + " AS judges, ") for x, y in ("ab", "ac", "bc")),
    "tie_breaker_calls": VOTES + "SELECT score_id, bool_or(a IS NULL OR b IS NULL OR a <> b) AS call_c, count(*) AS criteria, count(*) FILTER (a IS NULL OR b IS NULL OR a <> b) AS open_criteria FROM panels GROUP BY ALL",
    "recorded_against_derived": VOTES + "SELECT r.verdict AS recorded, r.consensus_method, d.verdict AS derived, d.method, count(*) AS criteria FROM criterion_results r LEFT JOIN decided d USING (score_id, criterion_id) GROUP BY ALL",
}
