"""Corpus of rulings: pairing, classification, reject reasons, area reports and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from giurispark.functions import text

#: Least length of the facts and least number of principles of a usable ruling.
MIN_FACTS, MIN_PRINCIPLES = 200, 1


def reject_reason(rulings: DataFrame) -> Column:
    """First reason to leave a ruling out; 'ok' for the usable ones. The order of the reasons is that of the counters."""
    return (
        F.when(~F.contains(F.coalesce("ecli_id", F.lit("")), F.lit("ECLI_IT_CASS")), "not_cassation")
        .when(F.trim(F.coalesce("division", F.lit(""))) == "Sez. 7", "excluded_division")
        .when(text.cassation_area(F.col("legal_area"), F.col("division")).isNull(), "unmapped")
        .when(F.length(F.coalesce("facts", F.lit(""))) < MIN_FACTS, "short_facts")
        .when(F.coalesce(F.size("principles"), F.lit(0)) < MIN_PRINCIPLES, "no_principles")
        .otherwise("ok")
    )


def classified(rulings: DataFrame) -> DataFrame:
    """Rulings with their canonical and derived area, suffix, previews and reject reason."""
    return rulings.withColumns({
        "area": text.area(F.col("macro_area")),
        "legal_area": F.upper(F.coalesce("legal_area", F.lit(""))),
        "derived_area": F.coalesce(text.cassation_area(F.col("legal_area"), F.col("division")), F.lit("")),
        "suffix": text.ecli_suffix(F.coalesce("ecli_id", F.lit(""))),
        "facts_preview": text.preview(F.col("facts")),
        "principle_preview": text.preview(F.get(F.coalesce("principles", F.array().cast("array<string>")), F.lit(0))),
        "reason": reject_reason(rulings),
    })


def accepted(rulings: DataFrame) -> DataFrame:
    """The corpus rows: usable rulings with nulls made empty."""
    return classified(rulings).where("reason = 'ok'").select(
        "ecli_id", F.col("derived_area").alias("macro_area"), F.coalesce("division", F.lit("")).alias("division"), "legal_area",
        F.coalesce("doc_type", F.lit("")).alias("doc_type"), F.coalesce("date", F.lit("")).alias("date"), "facts",
        F.coalesce("principles", F.array().cast("array<string>")).alias("principles"), F.coalesce("decision", F.lit("")).alias("decision"),
    )


def crosstab(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts of every pair with margins, long form; 'All' marks a margin."""
    label = lambda c: F.when(F.grouping(c) == 1, "All").otherwise(F.coalesce(F.col(c), F.lit(""))).alias(c)
    return df.cube(rows, columns).agg(F.count("*").alias("n"), label(rows).alias("r"), label(columns).alias("c")).select(F.col("r").alias(rows), F.col("c").alias(columns), "n")


def mismatches(df: DataFrame) -> DataFrame:
    return df.where((F.col("derived_area") != "") & (F.col("area") != F.col("derived_area")))
