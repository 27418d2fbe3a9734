"""Consensus of several annotators, their agreement and their reliability (problem 2).

Votes are reduced to what counts (of each annotator the latest valid one for an item),
and items to their voting patterns: which raters said what. Items that share a pattern
share everything that follows, so the iteration runs on a table of patterns with counts,
whose size depends on the number of raters and not of items.

Iteratively reweighted voting: votes weighted by the log odds of their raters' accuracies, and
the share of passes as prior, give each item a consensus (a probability of pass); the smoothed
share of a rater's votes that agree with it is the rater's accuracy. An item is weighed with
accuracies that leave out what the item itself gave to them, so no vote confirms itself. Both
alternate until no accuracy moves by more than ``tolerance``; if that does not come about
within ``rounds``, an error is raised. Agreement is chance-corrected for missing ratings
(nominal alpha over all items with two votes or more).

A third judge who is only called where two disagree sees hard items alone; agreement with
fellows would hold that against all three. The consensus of an item, which weighs all its votes,
does not: on settled items the accuracies are off by half a point in the mean.

Cases: unusable verdicts, failed votes and null judges do not count; repeated rows count
once; of equal times the larger verdict and model win; an item with a single vote has
this vote as leaning, agreement null, and no say in accuracies; tied weights lean to
neither; empty tables give empty results (alpha null).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from giurispark.functions.ecli import strip
from giurispark.session import cut

#: Up to so many patterns (some hundred bytes each) the table is settled in memory and sent to every task; beyond, joins shuffle. The result is the same.
SMALL = 100_000


def counting(votes: DataFrame, item: list[str], judge: str = "judge_id", model: str = "model", verdict: str = "verdict", status: str = "status", at: str = "voted_at") -> DataFrame:
    """The latest valid vote of each judge for each item: item columns, judge, model, verdict."""
    valid = votes.select(*item, F.upper(strip(F.col(judge))).alias("judge"), F.col(model).alias("model"), F.lower(strip(F.col(verdict))).alias("verdict"), F.col(status).alias("status"), F.col(at).alias("at")).where(
        "status = 'ok' AND verdict IN ('pass', 'fail') AND judge IS NOT NULL"
    )
    return valid.groupBy(*item, "judge").agg(F.max(F.struct("at", "verdict", "model")).alias("v")).select(*item, "judge", "v.model", "v.verdict")


def by_item(counted: DataFrame, item: list[str]) -> DataFrame:
    """One row per item: its votes, sorted; their number is at most the number of judges."""
    return counted.groupBy(*item).agg(F.array_sort(F.collect_list(F.struct("judge", "model", "verdict"))).alias("votes")).withColumns({
        "n_pass": F.size(F.filter("votes", lambda v: v["verdict"] == "pass")), "n_fail": F.size(F.filter("votes", lambda v: v["verdict"] == "fail")),
    })


def patterns(items: DataFrame) -> DataFrame:
    return items.groupBy("votes").agg(F.count("*").alias("n")).withColumn("pid", F.xxhash64("votes"))


#: Accuracy that smoothing leans to, and its weight in votes.
USUAL, WEIGHT = 0.75, 2.0
#: Bounds of an accuracy, so that no vote is worth nothing or everything.
LEAST, MOST = 0.501, 0.995


def reliability(table: DataFrame, tolerance: float = 1e-4, rounds: int = 1000, small: int = SMALL) -> DataFrame:
    """(judge, model, n_votes, compared, accuracy, weight) from the pattern table; compared counts votes on items with two or more.

    A table of at most ``small`` patterns is gathered and settled in memory, a larger one by joins; both do the same.
    """
    few = table.select("votes", "n").limit(small + 1).collect()  # bounded by small
    if len(few) <= small:
        rows = [(*k, *v) for k, v in _settled([(tuple((v["judge"], v["model"], v["verdict"] == "pass") for v in r["votes"]), float(r["n"])) for r in few], tolerance, rounds).items()]
        raters = table.sparkSession.createDataFrame(rows, "judge string, model string, n_votes long, num double, den double")
    else:
        raters = _joined(table, tolerance, rounds)
    accuracy = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), (F.col("num") + USUAL * WEIGHT) / (F.col("den") + WEIGHT)))
    return raters.select("judge", "model", "n_votes", F.col("den").alias("compared"), accuracy.alias("accuracy"), F.log(accuracy / (1 - accuracy)).alias("weight"))


def _settled(patterns: list[tuple[tuple, float]], tolerance: float, rounds: int) -> dict[tuple, tuple[int, float, float]]:
    """(votes, agreement, compared) of every rater (judge, model)."""
    raters = {r: i for i, r in enumerate(dict.fromkeys(v[:2] for votes, _ in patterns for v in votes))}
    if not raters:
        return {}
    place = np.repeat(np.arange(len(patterns)), [len(votes) for votes, _ in patterns])
    rater = np.array([raters[v[:2]] for votes, _ in patterns for v in votes])
    x = np.array([1.0 if v[2] else -1.0 for votes, _ in patterns for v in votes])
    count = np.array([n for _, n in patterns])
    one = np.array([float(len(votes) > 1) for votes, _ in patterns])[place]
    n = count[place]
    own, before, prior = USUAL * one, np.full(len(raters), 2.0), 0.5
    den = np.bincount(rater, n * one, len(raters))
    for _ in range(rounds):
        num = np.bincount(rater, n * own, len(raters))
        now = (num + USUAL * WEIGHT) / (den + WEIGHT)
        if np.abs(now - before).max() <= tolerance:
            return {r: (int(np.bincount(rater, n, len(raters))[i]), float(num[i]), float(den[i])) for r, i in raters.items()}
        a = np.clip((num[rater] - own + USUAL * WEIGHT) / (den[rater] - one + WEIGHT), LEAST, MOST)
        q = 1 / (1 + np.exp(-(np.bincount(place, x * np.log(a / (1 - a)), len(patterns)) + np.log(prior / (1 - prior)))))
        own, before = one * np.where(x > 0, q[place], 1 - q[place]), now
        prior = min(0.99, max(0.01, float((count * q).sum() / count.sum())))
    raise RuntimeError(f"accuracies are not settled after {rounds} rounds")


def _joined(table: DataFrame, tolerance: float, rounds: int) -> DataFrame:
    """(judge, model, n_votes, num, den): the same by joins over votes of patterns."""
    spread = table.select("votes", F.col("n").cast("double").alias("n"), (F.size("votes") > 1).cast("double").alias("one"), F.explode("votes").alias("v"))
    sign = F.when(F.col("v.verdict") == "pass", 1.0).otherwise(-1.0)
    # own: what an item of the pattern last gave to the rater; q: its probability of pass
    state = cut(spread.select("votes", "n", "one", F.col("v.judge").alias("judge"), F.col("v.model").alias("model"), sign.alias("x"), (F.lit(USUAL) * F.col("one")).alias("own"), F.lit(0.5).alias("q")))
    before: dict = {}
    for _ in range(rounds):
        raters = cut(state.groupBy("judge", "model").agg(F.sum("n").cast("long").alias("n_votes"), F.sum(F.col("n") * F.col("own")).alias("num"), F.sum(F.col("n") * F.col("one")).alias("den")))
        now = dict(map(tuple, raters.select(F.xxhash64("judge", "model"), (F.col("num") + USUAL * WEIGHT) / (F.col("den") + WEIGHT)).collect()))  # a row for each rater
        if all(abs(a - before.get(k, 2.0)) <= tolerance for k, a in now.items()):
            return raters
        share = state.groupBy("votes").agg(F.first("n").alias("n"), F.first("q").alias("q")).agg((F.sum(F.col("n") * F.col("q")) / F.sum("n")).alias("p")).select(F.greatest(F.lit(0.01), F.least(F.lit(0.99), "p")).alias("p"))  # one row
        r = raters.select(F.col("judge").alias("j"), F.col("model").alias("m"), "num", "den")
        a = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), (F.col("num") - F.col("own") + USUAL * WEIGHT) / (F.col("den") - F.col("one") + WEIGHT)))
        balance = state.join(r, F.expr("judge <=> j AND model <=> m")).groupBy("votes").agg(F.sum(F.col("x") * F.log(a / (1 - a))).alias("b"))
        q = balance.crossJoin(F.broadcast(share)).select("votes", (1 / (1 + F.exp(-(F.col("b") + F.log(F.col("p") / (1 - F.col("p"))))))).alias("q"))
        state = cut(state.drop("q").join(q, "votes").withColumn("own", F.col("one") * F.when(F.col("x") > 0, F.col("q")).otherwise(1 - F.col("q"))))
        before = now
    raise RuntimeError(f"accuracies are not settled after {rounds} rounds")


def leanings(table: DataFrame, raters: DataFrame) -> DataFrame:
    """(votes, leaning, confidence) of each pattern under the final weights."""
    single = table.select("votes", F.explode("votes").alias("v")).select("votes", "v.judge", "v.model", "v.verdict")
    joined = single.join(raters.select(F.col("judge").alias("j"), F.col("model").alias("m"), "weight"), F.expr("judge <=> j AND model <=> m"))
    return joined.groupBy("votes").agg(F.sum(F.when(F.col("verdict") == "pass", F.col("weight")).otherwise(-F.col("weight"))).alias("b")).select(
        "votes", F.when(F.col("b") > 1e-9, "pass").when(F.col("b") < -1e-9, "fail").otherwise("unresolved").alias("leaning"), (1 / (1 + F.exp(-F.abs("b")))).alias("confidence")
    )


def consensus(items: DataFrame, table: DataFrame, raters: DataFrame) -> DataFrame:
    """Items with the weighted leaning, its confidence, the verdict two judges share, and the item's agreement."""
    result = cut(leanings(table, raters))
    bound = F.broadcast(result) if result.count() <= SMALL else result
    n, p, f = F.col("n_pass") + F.col("n_fail"), F.col("n_pass"), F.col("n_fail")
    return items.join(bound, "votes", "left").withColumns({
        # the leaning stands where two judges share it; else what two judges share; else none
        "consensus": F.when((F.col("leaning") == "pass") & (p >= 2), "pass").when((F.col("leaning") == "fail") & (f >= 2), "fail").when((p >= 2) & (p > f), "pass").when((f >= 2) & (f > p), "fail").otherwise("unresolved"),
        "agreement": F.try_divide(p * (p - 1) + f * (f - 1), n * (n - 1)),
    })


def alpha(table: DataFrame) -> DataFrame:
    """Chance-corrected agreement over all items with two votes or more, from the pattern table."""
    p, f = F.size(F.filter("votes", lambda v: v["verdict"] == "pass")), F.size(F.filter("votes", lambda v: v["verdict"] == "fail"))
    sums = table.select("n", p.alias("p"), f.alias("f")).where("p + f >= 2").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.sum(F.col("n") * F.col("p")).alias("passes"), F.sum(F.col("n") * F.col("f")).alias("fails"),
        F.sum(F.col("n") * 2 * F.col("p") * F.col("f") / (F.col("p") + F.col("f") - 1)).alias("split"),
        F.sum(F.col("n") * (F.col("p") * (F.col("p") - 1) + F.col("f") * (F.col("f") - 1)) / ((F.col("p") + F.col("f")) * (F.col("p") + F.col("f") - 1))).alias("agree"),
    )
    total = F.col("passes") + F.col("fails")
    return sums.select(
        F.col("items").cast("long").alias("items"), total.cast("long").alias("votes"), F.round(F.try_divide(F.col("agree"), F.col("items")), 6).alias("observed"),
        F.round(1 - F.try_divide(F.col("split") / total, F.try_divide(2.0 * F.col("passes") * F.col("fails"), total * (total - 1))), 6).alias("alpha"),
    )
