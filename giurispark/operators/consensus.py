"""Consensus of a panel of three judges per criterion, its diagnostics and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from giurispark.functions import text
from giurispark.functions.ecli import strip

JUDGES = ("A", "B", "C")


def last_votes(votes: DataFrame, item: list[str]) -> DataFrame:
    """One vote for each judge and item, the latest: judge, verdict (normalised), status, valid."""
    shaped = votes.select(
        *item, F.upper(strip(F.col("judge_id"))).alias("judge"), F.lower(strip(F.col("verdict"))).alias("verdict"), "status", "model", "voted_at"
    ).where("judge IS NOT NULL")
    last = shaped.groupBy(*item, "judge").agg(F.max(F.struct("voted_at", "status", F.coalesce("verdict", F.lit("")).alias("verdict"), "model")).alias("v"))
    return last.select(*item, "judge", "v.verdict", "v.status", "v.model", ((F.col("v.status") == "ok") & F.col("v.verdict").isin("pass", "fail")).alias("valid"))


def panel(votes: DataFrame, item: list[str]) -> DataFrame:
    """Votes side by side: a, b, c are valid verdicts or null; label_a.. tell what became of each call."""
    label = F.when(F.col("status") != "ok", "error").otherwise(F.col("verdict"))
    aggs = []
    for j in JUDGES:
        own = F.col("judge") == j
        aggs += [F.max(F.when(own & F.col("valid"), F.col("verdict"))).alias(j.lower()), F.coalesce(F.max(F.when(own, label)), F.lit("not_called")).alias(f"label_{j.lower()}")]
    return votes.groupBy(*item).agg(*aggs)


def _rule(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    both, one = a.isNotNull() & b.isNotNull(), a.isNull() != b.isNull()
    sole, name = F.coalesce(a, b), F.when(a.isNotNull(), "A").otherwise("B")
    none = F.array().cast("array<string>")
    verdict = F.when(both & (a == b), a).when(both & c.isNotNull(), c).when(one & (c == sole), c).otherwise("unresolved")
    method = F.when(both & (a == b), "initial_agreement").when(both & c.isNotNull(), "tie_breaker").when(one & (c == sole), "recovery_agreement").otherwise("unresolved")
    supporters = (
        F.when(both & (a == b), F.array(F.lit("A"), F.lit("B")))
        .when(both & c.isNotNull(), F.array(F.when(a == c, "A").otherwise("B"), F.lit("C")))
        .when(one & (c == sole), F.array(name, F.lit("C")))
        .otherwise(none)
    )
    return verdict, method, supporters


def decide(panels: DataFrame) -> DataFrame:
    """Two of three: agreement of A and B, else the tie breaker C; a lost vote recovered by C; else unresolved."""
    verdict, method, supporters = _rule(F.col("a"), F.col("b"), F.col("c"))
    return panels.withColumns({"verdict": verdict, "method": method, "supporters": supporters, "tie_breaker_used": method == "tie_breaker"})


def needs_c(panels: DataFrame, task: str) -> DataFrame:
    """Whether a task's criteria call for judge C: once for all, as soon as one differs or lacks a vote."""
    differs = F.col("a").isNull() | F.col("b").isNull() | (F.col("a") != F.col("b"))
    return panels.groupBy(task).agg(F.max(differs).alias("call_c"), F.count("*").alias("criteria"), F.count_if(differs).alias("open_criteria"))


def single(panels: DataFrame, judge: str = "a") -> DataFrame:
    """One judge alone: the vote if valid."""
    return panels.withColumns({"verdict": F.coalesce(F.col(judge), F.lit("unresolved")), "supporters": F.when(F.col(judge).isNotNull(), F.array(F.lit(judge.upper()))).otherwise(F.array().cast("array<string>"))})


def combination(panels: DataFrame) -> DataFrame:
    return panels.withColumn("combination", F.concat_ws("|", *[F.concat(F.lit(f"{j}:"), F.col(f"label_{j.lower()}")) for j in JUDGES]))


def diagnostics(decided: DataFrame) -> DataFrame:
    """Rates of each method, calls of each judge and their share of passes, in one row."""
    rate = lambda x: F.round(F.coalesce(F.try_divide(F.count_if(F.col("method") == x), F.count("*")), F.lit(0.0)), 6)
    calls = lambda j: F.count_if(F.col(f"label_{j}") != "not_called")
    passes = lambda j: F.round(F.coalesce(F.try_divide(F.count_if(F.col(j) == "pass"), F.count(j)), F.lit(0.0)), 6)
    return decided.agg(
        F.count("*").alias("criteria_evaluated"), rate("initial_agreement").alias("initial_agreement_rate"), rate("tie_breaker").alias("tie_breaker_rate"),
        rate("recovery_agreement").alias("recovery_rate"), rate("unresolved").alias("unresolved_rate"),
        *[calls(j).alias(f"calls_{j}") for j in "abc"], *[passes(j).alias(f"pass_rate_{j}") for j in "abc"],
    )


def kappa(panels: DataFrame, x: str = "a", y: str = "b") -> DataFrame:
    """Cohen's kappa over the items both judges voted on; one row (null if none; 1 where chance leaves no room)."""
    both = panels.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.count("*").alias("n"), F.count_if(F.col(x) == F.col(y)).alias("same"), F.count_if(F.col(x) == "pass").alias("px"), F.count_if(F.col(y) == "pass").alias("py")
    )
    n = F.col("n").cast("double")
    chance = (F.col("px") * F.col("py") + (n - F.col("px")) * (n - F.col("py"))) / (n * n)
    return both.select("n", F.when(F.col("n") > 0, F.when(chance == 1, 1.0).otherwise((F.col("same") / n - chance) / (1 - chance))).alias("kappa")).withColumn("kappa", F.round("kappa", 6))


def explained(decided: DataFrame) -> Column:
    """The verdict in words, by method and supporters."""
    support = F.array_join(F.transform("supporters", lambda j: F.concat(F.lit("Judge "), j)), " e ")
    how = F.when(F.col("method") == "initial_agreement", "con consenso iniziale.").when(F.col("method") == "tie_breaker", "dopo attivazione del tie-breaker.").otherwise("dopo attivazione del recovery judge.")
    return F.when(F.col("method") == "unresolved", "Verdetto UNRESOLVED: non esistono due voti validi concordi.").otherwise(F.concat(F.lit("Verdetto "), F.upper("verdict"), F.lit(" sostenuto da "), support, F.lit(" "), how))


def completed(criteria: DataFrame, votes: DataFrame, item: list[str], judges: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """A vote of each judge for every criterion: the one cast, or an error vote where none is.

    criteria: item columns, each once; votes: as last_votes gives them. The judges are a fixed few, spelled out per criterion.
    """
    asked = criteria.select(*item, F.explode(F.array(*[F.lit(j) for j in judges])).alias("judge"))
    given = votes.select(*item, "judge", "verdict", "status", "valid")
    return asked.join(given, [*item, "judge"], "left").select(
        *item, "judge", F.when(F.col("valid"), F.col("verdict")).alias("verdict"), F.when(F.col("status").isNull(), "missing").when(F.col("valid"), "ok").otherwise("error").alias("status")
    )


def adapted(criteria: DataFrame, verdicts: DataFrame, item: list[str], missing: str) -> DataFrame:
    """Criteria with their verdict; one without gets ``missing`` (unresolved for a panel, fail for a single output)."""
    return criteria.join(verdicts.select(*item, "verdict"), item, "left").withColumn("verdict", F.coalesce("verdict", F.lit(missing)))


def coerced(reply: Column) -> dict[str, Column]:
    """A judge's reply as decision, reasoning and status: the first JSON object in it, its verdict without case and blanks; anything but pass or fail is an error vote."""
    record = text.json_object(reply)
    verdict = F.lower(strip(F.get_json_object(record, "$.verdict")))
    valid = F.coalesce(verdict.isin("pass", "fail"), F.lit(False))
    return {"decision": F.when(valid, verdict), "decision_status": F.when(valid, "ok").otherwise("error"), "decision_reasoning": F.get_json_object(record, "$.reasoning")}
