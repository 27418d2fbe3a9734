"""Queries over the corpus of rulings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from giurispark.functions import text
from giurispark.operators import corpus
from giurispark.operators.ranking import numbered
from giurispark.sources.tables import table


def _rulings(spark: SparkSession, base: str) -> DataFrame:
    return corpus.classified(table(spark, base, "provvedimenti"))


def corpus_reject_reasons(spark: SparkSession, base: str) -> DataFrame:
    return _rulings(spark, base).groupBy("reason").agg(F.count("*").alias("n"))


def corpus_accepted(spark: SparkSession, base: str) -> DataFrame:
    """Usable rulings, as sizes and keys."""
    return corpus.accepted(table(spark, base, "provvedimenti")).groupBy("ecli_id", "macro_area", "division", "doc_type").agg(
        F.count("*").alias("n"), F.sum(F.length("facts")).alias("chars"), F.sum(F.size("principles")).alias("principles")
    )


def unknown_combos(spark: SparkSession, base: str) -> DataFrame:
    label = lambda c: F.coalesce(F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")), F.lit("(vuota)")).alias(c)
    return _rulings(spark, base).where("reason = 'unmapped'").select(label("legal_area"), label("division")).groupBy("legal_area", "division").agg(F.count("*").alias("n"))


def corpus_by_area(spark: SparkSession, base: str) -> DataFrame:
    return _rulings(spark, base).groupBy("area").agg(F.count("*").alias("n"), F.countDistinct("ecli_id").alias("rulings"), F.round(F.avg(F.length("facts")), 4).alias("mean_chars"))


def area_filter(spark: SparkSession, base: str) -> DataFrame:
    """Rulings of one area, asked for in a legacy spelling."""
    return _rulings(spark, base).where(F.col("area") == text.area(F.lit("Diritto del Lavoro"), strict=True)).select("prov_id", "area", "division")


def area_crosstab(spark: SparkSession, base: str) -> DataFrame:
    return corpus.crosstab(_rulings(spark, base), "area", "legal_area")


def suffix_crosstab(spark: SparkSession, base: str) -> DataFrame:
    return corpus.crosstab(_rulings(spark, base), "area", "suffix")


def division_crosstab(spark: SparkSession, base: str) -> DataFrame:
    return corpus.crosstab(_rulings(spark, base).withColumn("division", F.coalesce("division", F.lit(""))), "division", "legal_area")


def audit_mismatch(spark: SparkSession, base: str) -> DataFrame:
    return corpus.mismatches(_rulings(spark, base)).select("prov_id", "ecli_id", "area", "derived_area", "legal_area", "division")


def audit_mismatch_top(spark: SparkSession, base: str) -> DataFrame:
    """The first twenty mismatches; the limit is the report's."""
    return corpus.mismatches(_rulings(spark, base)).orderBy("prov_id").limit(20).select("prov_id", "area", "derived_area")


def legal_area_counts(spark: SparkSession, base: str) -> DataFrame:
    """Values per area, nulls counted."""
    return table(spark, base, "provvedimenti").groupBy(text.area(F.col("macro_area")).alias("area"), "legal_area").agg(F.count("*").alias("n"))


def audit_rank(spark: SparkSession, base: str) -> DataFrame:
    """Order of the audit report."""
    ranked = _rulings(spark, base).withColumn("division", F.coalesce("division", F.lit(""))).withColumn("ecli_id", F.coalesce("ecli_id", F.lit("")))
    groups = ranked.groupBy("area", "legal_area", "division").agg(F.count("*").alias("n"), F.min(F.struct("ecli_id", "prov_id")).alias("f")).select("area", "legal_area", "division", "n", F.col("f.prov_id").alias("first_id"))
    return numbered(groups, [], [F.col("area").asc(), F.col("legal_area").asc(), F.col("division").asc()])


def text_previews(spark: SparkSession, base: str) -> DataFrame:
    return _rulings(spark, base).select("prov_id", "facts_preview", "principle_preview", "suffix")


def latest_delivery(spark: SparkSession, base: str) -> DataFrame:
    """Of a ruling delivered again the last delivery."""
    return table(spark, base, "provvedimenti", "prov_id", "ecli_id", "ingested_at").groupBy("ecli_id").agg(F.max_by("prov_id", F.struct("ingested_at", "prov_id")).alias("prov_id"), F.count("*").alias("deliveries"))


QUERIES = {f.__name__: f for f in (
    corpus_reject_reasons, corpus_accepted, unknown_combos, corpus_by_area, area_filter, area_crosstab, suffix_crosstab, division_crosstab,
    audit_mismatch, audit_mismatch_top, legal_area_counts, audit_rank, text_previews, latest_delivery,
)}
WS = "E' \\t\\n\\r'"


def area_sql(column: str) -> str:
    """SQL for the canonical area of a column."""
    key = f"trim(regexp_replace(replace(replace(lower(strip_accents(trim(coalesce({column}, ''), {WS}))), 'ß', 'ss'), '&', ' e '), '[^a-z0-9]+', '_', 'g'), '_')"
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.ALIASES.items()) + "}"
    return (
        f"(CASE WHEN contains({key}, 'privacy') AND contains({key}, 'procedura_civile') THEN 'diritto_civile' WHEN {known}[{key}] IS NOT NULL THEN {known}[{key}] "
        f"WHEN regexp_matches({key}, '^(penale_|diritto_penale_)|_penale$') THEN 'diritto_penale' ELSE {key} END)"
    )


def preview_sql(expr: str) -> str:
    flat = f"trim(regexp_replace(coalesce({expr}, ''), '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}\\x{{2028}}\\x{{2029}}\\x{{205F}}\\x{{1680}}\\x{{85}}]+', ' ', 'g'))"
    return f"(CASE WHEN length({flat}) > 180 THEN substring({flat}, 1, 180) || '...' ELSE {flat} END)"


RULINGS = f"""WITH base AS (SELECT prov_id, ecli_id, {area_sql('macro_area')} AS area, upper(coalesce(legal_area, '')) AS legal_area, division, doc_type, date, facts, principles, decision FROM provvedimenti),
derived AS (SELECT *, coalesce(CASE WHEN trim(coalesce(division, '')) = 'Sez. 7' THEN NULL
  WHEN trim(legal_area) = 'PEN' AND trim(division) IN ('Sez. 1', 'Sez. 2', 'Sez. 3', 'Sez. 4', 'Sez. 5', 'Sez. 6', 'Sez. U') THEN 'diritto_penale'
  WHEN trim(legal_area) = 'CIV' AND trim(division) IN ('Sez. 1', 'Sez. 2', 'Sez. 3', 'Sez. U') THEN 'diritto_civile'
  WHEN trim(legal_area) = 'CIV' AND trim(division) = 'Sez. 5' THEN 'diritto_tributario'
  WHEN trim(legal_area) = 'CIV' AND trim(division) = 'Sez. L' THEN 'diritto_lavoro' END, '') AS derived_area, regexp_extract(coalesce(ecli_id, ''), '(CIV|PEN)$', 1) AS suffix FROM base),
rulings AS (SELECT *, CASE WHEN NOT contains(coalesce(ecli_id, ''), 'ECLI_IT_CASS') THEN 'not_cassation' WHEN trim(coalesce(division, '')) = 'Sez. 7' THEN 'excluded_division'
  WHEN derived_area = '' THEN 'unmapped' WHEN length(coalesce(facts, '')) < 200 THEN 'short_facts' WHEN coalesce(len(principles), 0) < 1 THEN 'no_principles' ELSE 'ok' END AS reason FROM derived)
"""


def _cross(a: str, b: str) -> str:
    return RULINGS + f"SELECT CASE WHEN grouping({a}) = 1 THEN 'All' ELSE coalesce({a}, '') END AS {a}, CASE WHEN grouping({b}) = 1 THEN 'All' ELSE coalesce({b}, '') END AS {b}, count(*) AS n FROM (SELECT area, legal_area, suffix, coalesce(division, '') AS division FROM rulings) GROUP BY CUBE ({a}, {b})"


ORACLE = {
    "corpus_reject_reasons": RULINGS + "SELECT reason, count(*) AS n FROM rulings GROUP BY ALL",
    "corpus_accepted": RULINGS + "SELECT ecli_id, derived_area AS macro_area, coalesce(division, '') AS division, coalesce(doc_type, '') AS doc_type, count(*) AS n, CAST(sum(length(facts)) AS BIGINT) AS chars, CAST(sum(len(principles)) AS BIGINT) AS principles FROM rulings WHERE reason = 'ok' GROUP BY ALL",
    "unknown_combos": RULINGS + "SELECT coalesce(nullif(trim(legal_area), ''), '(vuota)') AS legal_area, coalesce(nullif(trim(coalesce(division, '')), ''), '(vuota)') AS division, count(*) AS n FROM rulings WHERE reason = 'unmapped' GROUP BY ALL",
    "corpus_by_area": RULINGS + "SELECT area, count(*) AS n, count(DISTINCT ecli_id) AS rulings, round(avg(length(facts)), 4) AS mean_chars FROM rulings GROUP BY ALL",
    "area_filter": RULINGS + "SELECT prov_id, area, division FROM rulings WHERE area = 'diritto_lavoro'",
    "area_crosstab": _cross("area", "legal_area"),
    "suffix_crosstab": _cross("area", "suffix"),
    "division_crosstab": _cross("division", "legal_area"),
    "audit_mismatch": RULINGS + "SELECT prov_id, ecli_id, area, derived_area, legal_area, division FROM rulings WHERE derived_area <> '' AND area <> derived_area",
    "audit_mismatch_top": RULINGS + "SELECT prov_id, area, derived_area FROM rulings WHERE derived_area <> '' AND area <> derived_area ORDER BY prov_id LIMIT 20",
    "legal_area_counts": f"SELECT {area_sql('macro_area')} AS area, legal_area, count(*) AS n FROM provvedimenti GROUP BY ALL",
    "audit_rank": RULINGS + "SELECT area, legal_area, division, n, f.prov_id AS first_id, row_number() OVER (ORDER BY area, legal_area, division) AS position FROM (SELECT area, legal_area, coalesce(division, '') AS division, count(*) AS n, min({'e': coalesce(ecli_id, ''), 'prov_id': prov_id}) AS f FROM rulings GROUP BY ALL)",
    "text_previews": RULINGS + f"SELECT prov_id, {preview_sql('facts')} AS facts_preview, {preview_sql('principles[1]')} AS principle_preview, suffix FROM rulings",
    "latest_delivery": "SELECT ecli_id, arg_max(prov_id, {'i': ingested_at, 'p': prov_id}) AS prov_id, count(*) AS deliveries FROM provvedimenti GROUP BY ALL",
}
