import itertools

from giurispark.operators import consensus

STATES = ("pass", "fail", "error", None)


def expected(a, b, c):
    ok = lambda v: v in ("pass", "fail")
    if ok(a) and ok(b):
        if a == b:
            return a, "initial_agreement", ["A", "B"], False
        return (c, "tie_breaker", ["A" if a == c else "B", "C"], True) if ok(c) else ("unresolved", "unresolved", [], False)
    if ok(a) or ok(b):
        sole = a if ok(a) else b
        if ok(c) and c == sole:
            return c, "recovery_agreement", ["A" if ok(a) else "B", "C"], False
    return "unresolved", "unresolved", [], False


def test_truth_table(spark):
    rows = []
    for i, states in enumerate(itertools.product(STATES, repeat=3)):
        rows += [(i, "C-001", j, None if s == "error" else s, "error" if s == "error" else "ok", "m", None) for j, s in zip("ABC", states) if s is not None]
    votes = spark.createDataFrame(rows, "score_id long, criterion_id string, judge_id string, verdict string, status string, model string, voted_at timestamp_ntz")
    got = {r.score_id: r for r in consensus.decide(consensus.panel(consensus.last_votes(votes, ["score_id", "criterion_id"]), ["score_id", "criterion_id"])).collect()}
    for i, states in enumerate(itertools.product(STATES, repeat=3)):
        if any(s is not None for s in states):
            r = got[i]
            assert (r.verdict, r.method, r.supporters, r.tie_breaker_used) == expected(*states), states


def test_kappa_edges(spark):
    empty = spark.createDataFrame([], "a string, b string")
    assert consensus.kappa(empty).first().kappa is None
    same = spark.createDataFrame([("pass", "pass")] * 3, "a string, b string")
    assert consensus.kappa(same).first().kappa == 1.0
