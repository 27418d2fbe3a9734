"""Queries over references to missing records (problem 3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from giurispark.functions import ecli
from giurispark.operators.orphans import orphans
from giurispark.sources.tables import table

#: Table, key of its records, column that names a ruling, time of the reference.
REFERENCES = (
    ("citations", "citation_id", "ecli", "extracted_at"),
    ("registry_candidates", "candidate_id", "ecli", "resolved_at"),
    ("benchmark_tasks", "task_id", "source_ecli", "created_at"),
)


def references(spark: SparkSession, base: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (
        table(spark, base, name).select(F.lit(name).alias("src_table"), F.col(key).cast("string").alias("record_key"), F.col(ref).alias("ref"), F.col(time).alias("ref_time"))
        for name, key, ref, time in REFERENCES
    ))


def found_rows(spark: SparkSession, base: str) -> DataFrame:
    registry = table(spark, base, "registry").select(F.col("ecli").alias("key"), "loaded_at", "deleted_at")
    return orphans(references(spark, base), registry, ecli.canonical, "loaded_at", "deleted_at")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return found_rows(spark, base).select("src_table", "record_key", "kind")


def p3_monthly(spark: SparkSession, base: str) -> DataFrame:
    """Orphans per table, month and kind."""
    return (
        found_rows(spark, base)
        .groupBy("src_table", F.date_format("ref_time", "yyyy-MM").alias("month"), "kind")
        .agg(F.count("*").alias("orphans"))
    )


QUERIES = {"p3_found": p3_found, "p3_monthly": p3_monthly}

_CANON = "replace(nullif(regexp_extract(upper({0}), 'ECLI[:_][A-Z]{{2}}[:_][A-Z0-9]+[:_][0-9]{{4}}[:_][A-Z0-9.-]+'), ''), '_', ':')"
_ORPHANS = "WITH refs AS (" + " UNION ".join(
    f"SELECT DISTINCT '{name}' AS src_table, CAST({key} AS VARCHAR) AS record_key, {_CANON.format(ref)} AS k, {time} AS t FROM {name} WHERE {ref} IS NOT NULL"
    for name, key, ref, time in REFERENCES
) + f"""), reg AS (SELECT {_CANON.format('ecli')} AS k, loaded_at AS s, deleted_at AS e FROM registry WHERE ecli IS NOT NULL),
seen AS (SELECT src_table, record_key, refs.k, t, bool_or(s <= t AND (e IS NULL OR e > t)) AS valid, bool_or(s <= t) AS loaded, count(reg.k) AS n
         FROM refs LEFT JOIN reg USING (k) GROUP BY ALL),
orphans AS (SELECT src_table, record_key, t, CASE WHEN n = 0 THEN 'missing' WHEN loaded THEN 'deleted' ELSE 'late' END AS kind FROM seen WHERE NOT coalesce(valid, false))
"""
ORACLE = {
    "p3_found": _ORPHANS + "SELECT src_table, record_key, arg_min(kind, t) AS kind FROM orphans GROUP BY src_table, record_key",
    "p3_monthly": _ORPHANS + "SELECT src_table, strftime(t, '%Y-%m') AS month, kind, count(*) AS orphans FROM (SELECT src_table, record_key, min(t) AS t, arg_min(kind, t) AS kind FROM orphans GROUP BY src_table, record_key) GROUP BY ALL",
}
