import datetime as dt
import random

from pyspark.sql import functions as F

from giurispark.operators.orphans import orphans

DAY = dt.datetime(2024, 1, 1)


def run(spark, refs, registry, batch=200_000):
    r = spark.createDataFrame(refs, "src_table string, record_key string, ref string, ref_time timestamp_ntz, spans string")
    g = spark.createDataFrame(registry, "key string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, kind string")
    return sorted((x.src_table, x.record_key, x.kind) for x in orphans(r, g, lambda c: F.upper(c), "loaded_at", "deleted_at", batch).collect())


def day(n):
    return DAY + dt.timedelta(days=n)


def test_kinds_nulls_and_repeats(spark):
    registry = [("a", day(5), day(10), ""), ("A", day(20), None, ""), ("a", day(5), day(10), ""), ("b", None, None, ""), (None, day(1), None, "")]
    refs = [("t", str(i), "a", day(n), "x") for i, n in enumerate((0, 5, 9, 10, 15, 20, 99))] + [("t", "b", "b", day(3), ""), ("t", "n", None, day(3), ""), ("t", "m", "zz", day(3), ""), ("t", "m", "zz", day(3), ""), ("t", "u", "a", None, "")]
    assert run(spark, refs, registry) == sorted([("t", "0", "late"), ("t", "3", "deleted"), ("t", "4", "deleted"), ("t", "b", "late"), ("t", "m", "missing"), ("t", "u", "late")])


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [("t", "1", "a", day(1), "")], []) == [("t", "1", "missing")]


def test_against_brute_force_with_a_hot_key(spark):
    rnd = random.Random(3)
    registry = [(f"k{rnd.randrange(60)}", day(rnd.randrange(50)), day(rnd.randrange(50, 90)) if rnd.random() < 0.6 else None, "") for _ in range(120)]
    refs = [("t", str(i), "k1" if i % 3 == 0 else f"k{rnd.randrange(70)}", day(rnd.randrange(100)), "") for i in range(900)]
    want = []
    for _, key, ref, t, _ in refs:
        own = [x for x in registry if x[0] == ref]
        if not any(s <= t and (e is None or e > t) for _, s, e, _ in own):
            want.append(("t", key, "missing" if not own else "deleted" if any(s <= t for _, s, _, _ in own) else "late"))
    assert run(spark, refs, registry, batch=50) == sorted(want)
