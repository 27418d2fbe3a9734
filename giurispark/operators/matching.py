"""Matching of tables of questions, ids and answers, with what does not match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def by_key(left: DataFrame, right: DataFrame, key: Column, left_id: str, right_id: str, text: str) -> DataFrame:
    """Pairs (left_id, right_id) whose texts give the same key."""
    a = left.select(left_id, key.alias("k"))
    b = right.select(right_id, key.alias("k"))
    return a.join(b, "k").select(left_id, right_id)


def missing_and_extra(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Keys expected but not given ('missing'), given but not expected ('extra'), or given more than once ('duplicate')."""
    missing = expected.select(key).distinct().join(given.select(key), key, "left_anti").withColumn("problem", F.lit("missing"))
    extra = given.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra).unionByName(duplicates(given, key).select(key, F.lit("duplicate").alias("problem")))


def require_none(df: DataFrame, what: str) -> None:
    """Raise if df has a row; one row is looked at."""
    if rows := df.limit(1).collect():
        raise ValueError(f"{what}: {rows[0].asDict()}")


def row_problems(df: DataFrame, question: str, answer: str) -> DataFrame:
    """Rows of a sheet with a blank half."""
    blank = lambda c: F.coalesce(F.regexp_replace(F.col(c), r"(?U)\s", ""), F.lit("")) == ""
    return df.withColumn("problem", F.when(blank(question) & blank(answer), "blank").when(blank(question), "no question").when(blank(answer), "no answer")).where("problem IS NOT NULL")


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Of repeated keys the last one in a stated order."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def sampled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same for the same seed wherever they lie: the least digests of seed and key.

    Fewer rows than n give all. The order is found by a bounded top-n of every task, not by a full sort.
    """
    mark = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_mark", mark).orderBy("_mark", key).limit(n).drop("_mark")


def sampled_by(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group: only n digests of a group are ever held together."""
    mark = F.struct(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))).alias("d"), F.col(key).alias("k"))
    first = _least(df, group, mark, n)
    return df.join(first, df[key] == first["_key"], "left_semi")


def _least(df: DataFrame, group: str, mark: Column, n: int) -> DataFrame:
    # a first cut within every task keeps a hot group from meeting in one place
    part = df.select(F.col(group).alias("_g"), mark.alias("_m")).withColumn("_p", F.spark_partition_id())
    inner = part.withColumn("_n", F.row_number().over(Window.partitionBy("_g", "_p").orderBy("_m"))).where(F.col("_n") <= n)
    return inner.withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy("_m"))).where(F.col("_n") <= n).select(F.col("_m.k").alias("_key"))


def of_area(tasks: DataFrame, area: str) -> DataFrame:
    """Tasks whose area, as written, or whose id's first part is the area, whatever the case; no aliases."""
    want = area.lower()
    return tasks.where((F.lower(F.coalesce("macro_area", F.lit(""))) == want) | (F.lower(F.substring_index("task_id", "/", 1)) == want))


def of_areas(frames: list[DataFrame], areas: list[str], key: str = "macro_area") -> list[DataFrame]:
    """Several frames narrowed to the same areas; an error where nothing of the first is left."""
    kept = [f.where(F.col(key).isin(*areas)) for f in frames]
    if kept[0].isEmpty():
        raise ValueError(f"no rows for {areas}")
    return kept


def sampled_sorted(df: DataFrame, key: str, n: int, seed: int, strict: bool = False) -> DataFrame:
    """The sample in the order of its key; 0 means no limit, or, where strict, any n below 1 is an error."""
    if strict and n <= 0:
        raise ValueError("the limit must be positive")
    return (sampled(df, key, n, seed) if n > 0 else df).orderBy(key)


def parsed_criteria(reply: Column, most: int = 4) -> Column:
    """Criteria (id, title, match_criteria) from a generated JSON list: fences off, items with title and rule only, at most so many (the task's limit), numbered from C-001; null where there is no list or none is left."""
    bare = F.regexp_replace(F.regexp_replace(reply, r"```json\s*", ""), r"```\s*", "")
    items = F.from_json(bare, "array<struct<title: string, match_criteria: string>>")
    good = F.filter(F.transform(items, lambda c: F.struct(F.trim(c["title"]).alias("title"), F.trim(c["match_criteria"]).alias("match_criteria"))), lambda c: (F.coalesce(c["title"], F.lit("")) != "") & (F.coalesce(c["match_criteria"], F.lit("")) != ""))
    numbered = F.transform(F.slice(good, 1, most), lambda c, i: F.struct(F.format_string("C-%03d", i + 1).alias("id"), c["title"].alias("title"), c["match_criteria"].alias("match_criteria")))
    return F.when(F.size(numbered) > 0, numbered)
