"""All core queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from giurispark.plans import corpus, grounding, judging, references, reports, scores, texts, validation

MODULES = (references, judging, corpus, reports, grounding, texts, scores, validation)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}


def flagship(spark: SparkSession, base: str) -> DataFrame:
    return grounding.grounding_by_task(spark, base)
