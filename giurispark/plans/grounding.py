"""Queries over citations, the registry and question profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from giurispark.functions import ecli
from giurispark.operators import resolution as res
from giurispark.plans.references import _CANON
from giurispark.session import cut
from giurispark.sources.tables import table


def _resolved(spark: SparkSession, base: str) -> DataFrame:
    return res.resolve(table(spark, base, "citations"), table(spark, base, "registry"))


def _registry(spark: SparkSession, base: str) -> DataFrame:
    return res.current_registry(table(spark, base, "registry"))


def _profiles(spark: SparkSession, base: str) -> DataFrame:
    """A task's own source resolves it; what its citations were surely traced to is the retrieved rest."""
    own = table(spark, base, "benchmark_tasks").select("task_id", ecli.canonical(F.col("source_ecli")).alias("ecli"), F.lit(True).alias("resolving"))
    sure = table(spark, base, "registry_candidates", "citation_id", "ecli", "confidence").where("confidence = 'high'")
    asked = table(spark, base, "citations", "citation_id", "task_id").distinct()
    retrieved = sure.join(asked, "citation_id").select("task_id", ecli.canonical(F.col("ecli")).alias("ecli"), F.lit(False).alias("resolving"))
    return own.unionByName(retrieved).where("ecli IS NOT NULL").groupBy("task_id", "ecli").agg(F.max("resolving").alias("resolving"))


def _grounded(spark: SparkSession, base: str) -> DataFrame:
    registry = cut(_registry(spark, base))  # what covers and what resolves is the same
    places, years = res.registry_coverage(registry)
    return res.ground(res.resolve(table(spark, base, "citations"), registry, registry), _profiles(spark, base), places, years)


def registry_current(spark: SparkSession, base: str) -> DataFrame:
    return _registry(spark, base).drop("norm_area", "norm_type", "norm_sector")


def registry_stats(spark: SparkSession, base: str) -> DataFrame:
    return _registry(spark, base).groupBy("namespace").agg(F.count("*").alias("n"), F.countDistinct("court").alias("courts"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def registry_coverage_years(spark: SparkSession, base: str) -> DataFrame:
    """Rows per Cassation year, and whether the year counts as covered."""
    return _registry(spark, base).where("namespace = 'CASS'").groupBy("year").agg(F.count("*").alias("n")).withColumn("covered", F.col("n") >= res.COVERED_ROWS)


def registry_places(spark: SparkSession, base: str) -> DataFrame:
    return res.registry_coverage(_registry(spark, base))[0]


def citation_components(spark: SparkSession, base: str) -> DataFrame:
    return res.components(table(spark, base, "citations")).drop("text")


def citation_routes(spark: SparkSession, base: str) -> DataFrame:
    return res.route(res.components(table(spark, base, "citations"))).groupBy("namespace", "method").agg(F.count("*").alias("n"), F.count("target").alias("with_target"), F.count("prefix").alias("with_prefix"))


def prefix_topk(spark: SparkSession, base: str) -> DataFrame:
    """First registry ids of every prefix, capped before any filter."""
    routed = res.route(res.components(table(spark, base, "citations"))).where("prefix IS NOT NULL")
    return res.prefix_hits(routed, _registry(spark, base)).select("namespace", "prefix", "hit", "place")


def resolution_states(spark: SparkSession, base: str) -> DataFrame:
    return _resolved(spark, base).select("citation_id", "method", "status", "accuracy", "matched", "candidates", "final_status")


def resolution_counts(spark: SparkSession, base: str) -> DataFrame:
    return _resolved(spark, base).groupBy("method", "status", "accuracy", "final_status").agg(F.count("*").alias("n"))


def status_histogram(spark: SparkSession, base: str) -> DataFrame:
    """Final statuses, those that do not occur with zero."""
    counts = _resolved(spark, base).groupBy("final_status").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(s,) for s in res.STATUSES], "final_status string")
    return every.join(counts, "final_status", "left").select("final_status", F.coalesce("n", F.lit(0)).alias("n"))


def report_summary(spark: SparkSession, base: str) -> DataFrame:
    """Per answer: citations, different ones, resolved ones, and whether one is a hard failure."""
    key = F.coalesce(F.nullif(F.array_join(F.array_sort("requested"), "|"), F.lit("")), F.col("ecli"), F.col("text"))
    return _resolved(spark, base).groupBy("score_id").agg(
        F.count("*").alias("citations"), F.countDistinct(key).alias("distinct_keys"), F.count_if(F.col("status") == "resolved").alias("resolved"), F.max(F.col("final_status") == "not_found_in_index").alias("hard_fail")
    )


def citation_relations(spark: SparkSession, base: str) -> DataFrame:
    return _grounded(spark, base).select("citation_id", "final_status", "relation")


def sector_conflicts(spark: SparkSession, base: str) -> DataFrame:
    """Fields in which citations with an identifier contradict the registry or go beyond it, by section and registered sector."""
    routed = res.route(res.components(table(spark, base, "citations"))).where("method IN ('exact_ecli', 'constructed_ecli')")
    joined = res.with_diagnostics(routed, _registry(spark, base), "target").where("hit IS NOT NULL")
    return joined.groupBy("sector", "division", F.col("r_sector"), F.array_join("mismatch", "+").alias("mismatch"), F.array_join("incomplete", "+").alias("incomplete")).agg(F.count("*").alias("n"))


def coverage_notes(spark: SparkSession, base: str) -> DataFrame:
    """What stands in the way of verifying citations that are not found."""
    return _grounded(spark, base).where("final_status = 'not_found_in_index'").groupBy("relation", "note").agg(F.count("*").alias("n"))


def citation_relation_hist(spark: SparkSession, base: str) -> DataFrame:
    return res.relation_counts(_grounded(spark, base))


def grounding_by_task(spark: SparkSession, base: str) -> DataFrame:
    return res.relation_counts(_grounded(spark, base), "task_id", "score_id")


def _records(spark: SparkSession, base: str) -> DataFrame:
    return grounding_by_task(spark, base).select("task_id", F.col("score_id").alias("ordinal"), "citations_total", "issue_aligned")


def grounding_gog_coverage(spark: SparkSession, base: str) -> DataFrame:
    return res.grounding_summary(_records(spark, base))


def grounding_fixed_tasks(spark: SparkSession, base: str) -> DataFrame:
    """The same over a fixed number of tasks asked for."""
    return res.grounding_summary(_records(spark, base), 67)


def profile_sizes(spark: SparkSession, base: str) -> DataFrame:
    return _profiles(spark, base).groupBy("task_id").agg(F.count_if("resolving").alias("resolving"), F.count("*").alias("retrieved"))


def coverage_namespaces(spark: SparkSession, base: str) -> DataFrame:
    """Courts that citations name, and whether the registry has them."""
    places = res.registry_coverage(_registry(spark, base))[0]
    named = res.components(table(spark, base, "citations")).select(ecli.part(F.col("ecli"), 2).alias("place")).where("place IS NOT NULL").groupBy("place").agg(F.count("*").alias("citations"))
    return named.join(places.withColumn("covered", F.lit(True)), "place", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


QUERIES = {f.__name__: f for f in (
    registry_current, registry_stats, registry_coverage_years, registry_places, citation_components, citation_routes, prefix_topk, resolution_states, resolution_counts, status_histogram,
    report_summary, citation_relations, sector_conflicts, coverage_notes, citation_relation_hist, grounding_by_task, grounding_gog_coverage, grounding_fixed_tasks, profile_sizes, coverage_namespaces,
)}

WS = "E' \\t\\n\\r'"
_kind = lambda c: f"(CASE WHEN rtrim(upper(trim({c}, {WS})), '.') IN ('SENTENZA', 'SENT') THEN 'SENT' WHEN rtrim(upper(trim({c}, {WS})), '.') IN ('ORDINANZA', 'ORD') THEN 'ORD' WHEN rtrim(upper(trim({c}, {WS})), '.') IN ('DECRETO', 'DEC') THEN 'DEC' END)"
_area = lambda c: f"(CASE WHEN rtrim(upper(trim({c}, {WS})), '.') IN ('CIV', 'CIVILE') THEN 'CIV' WHEN rtrim(upper(trim({c}, {WS})), '.') IN ('PEN', 'PENALE') THEN 'PEN' END)"
_words = lambda c: f"trim(upper(regexp_replace(strip_accents({c}), '[^A-Za-z0-9]+', ' ', 'g')))"
_space = "(CASE WHEN split_part(ecli, ':', 2) = 'IT' THEN CASE WHEN split_part(ecli, ':', 3) IN ('CASS', 'COST', 'CONT', 'ABF', 'COVIP') THEN split_part(ecli, ':', 3) WHEN split_part(ecli, ':', 3) = 'CDS' OR starts_with(split_part(ecli, ':', 3), 'TAR') THEN 'ADM' WHEN split_part(ecli, ':', 3)[:3] IN ('CG1', 'CG2') THEN 'TAX' WHEN split_part(ecli, ':', 3)[:2] IN ('CA', 'TR') THEN 'MER' END END)"
_FIELDS = ["namespace", "court", "year", "number", "legal_area", "doc_type", "sector", "publication_date", "deleted_at"]
REG = f"""WITH loads AS (SELECT {_CANON.format('ecli')} AS ecli, max({{'loaded_at': loaded_at, """ + ", ".join(f"'{f}': coalesce(CAST({f} AS VARCHAR), '')" for f in _FIELDS) + f"""}}) AS r FROM registry WHERE ecli IS NOT NULL GROUP BY 1),
reg AS (SELECT ecli, nullif(r.namespace, '') AS namespace, nullif(r.court, '') AS court, CAST(nullif(r.year, '') AS INT) AS year, CAST(nullif(r.number, '') AS BIGINT) AS number, nullif(r.legal_area, '') AS legal_area, nullif(r.doc_type, '') AS doc_type,
  nullif(r.sector, '') AS sector, nullif(r.publication_date, '') AS publication_date FROM loads WHERE ecli IS NOT NULL AND r.deleted_at = ''),
years AS (SELECT year FROM reg WHERE namespace = 'CASS' GROUP BY year HAVING count(*) >= 1000),
places AS (SELECT DISTINCT place FROM (SELECT unnest([namespace, court]) AS place FROM reg) WHERE place IS NOT NULL)
"""
_sect = f"(CASE WHEN {_words('r.sector')} IN ('SU', 'SS UU', 'SEZ UN', 'SEZ UNITE', 'SEZIONI UNITE', 'CASSSU') THEN 'SU' WHEN {_words('r.sector')} IN ('L', 'LAV', 'LAVORO', 'SEZ L', 'SEZ LAV', 'SEZ LAVORO', 'CASSLAV') THEN 'L' END)"
_RAW = ["score_id", "task_id", "text", "ecli", "suggested_namespace", "number", "year", "legal_area", "section", "doc_type", "outside_index_scope"]
PARTS = REG + """, best AS (SELECT citation_id, max({""" + ", ".join(f"'{c}': coalesce(CAST({c} AS VARCHAR), '')" for c in _RAW) + f"""}}) AS r FROM citations GROUP BY citation_id),
one AS (SELECT citation_id, CAST(r.score_id AS BIGINT) AS score_id, nullif(r.task_id, '') AS task_id, nullif(r.text, '') AS text, {_CANON.format("nullif(r.ecli, '')")} AS ecli, nullif(r.suggested_namespace, '') AS ns, nullif(r.number, '') AS number, CAST(nullif(r.year, '') AS INT) AS year,
  nullif(r.legal_area, '') AS legal_area, nullif(r.section, '') AS section, nullif(r.doc_type, '') AS doc_type, r.outside_index_scope = 'true' AS outside FROM best),
plain_parts AS (SELECT citation_id, score_id, task_id, text, coalesce(outside, false) AS outside, ecli, coalesce({_space}, CASE WHEN upper(trim(ns, {WS})) IN ('CASS', 'MER', 'ADM', 'COST', 'CONT', 'TAX', 'ABF', 'COVIP') THEN upper(trim(ns, {WS})) END) AS namespace,
  CASE WHEN year BETWEEN 1000 AND 9999 THEN year END AS year, CASE WHEN regexp_full_match(trim(number, {WS}), '[0-9]+') THEN coalesce(nullif(ltrim(trim(number, {WS}), '0'), ''), '0') END AS number, {_area('legal_area')} AS legal_area, {_kind('doc_type')} AS doc_type,
  nullif(regexp_replace({_words('section')}, '^(SEZ|SEZIONE) ', ''), '') AS division, {_sect.replace('r.sector', 'section')} AS section_sector FROM one),
parts AS (SELECT * EXCLUDE (section_sector), CASE WHEN namespace = 'CASS' THEN section_sector END AS sector FROM plain_parts),
routed AS (SELECT *, CASE WHEN outside THEN 'outside' WHEN namespace IS NULL OR (namespace = 'COVIP' AND ecli IS NULL) THEN 'insufficient' WHEN ecli IS NOT NULL THEN 'exact_ecli' WHEN year IS NULL OR number IS NULL THEN 'insufficient'
    WHEN namespace = 'CASS' THEN 'cassation' WHEN namespace IN ('COST', 'ABF') THEN 'constructed_ecli' WHEN namespace = 'CONT' THEN 'prefix' ELSE 'insufficient' END AS method,
  coalesce(ecli, CASE WHEN year IS NOT NULL AND number IS NOT NULL THEN CASE WHEN namespace = 'CASS' AND legal_area IS NOT NULL THEN 'ECLI:IT:CASS:' || year || ':' || number || legal_area WHEN namespace IN ('COST', 'ABF') THEN 'ECLI:IT:' || namespace || ':' || year || ':' || number END END) AS target,
  CASE WHEN year IS NOT NULL AND number IS NOT NULL THEN CASE WHEN namespace = 'CASS' AND legal_area IS NULL THEN 'ECLI:IT:CASS:' || year || ':' || number WHEN namespace = 'CONT' THEN 'ECLI:IT:CONT:' || year || ':' || number END END AS prefix FROM parts)
"""
_plenary = f"(coalesce(c.division <> 'SU', false) AND coalesce({_sect} = 'SU', false))"
_sector_mis = f"(coalesce(c.sector <> {_sect}, false) OR (coalesce(c.sector = 'L', false) AND {_sect} IS NULL AND coalesce({_area('r.legal_area')} = 'PEN', false)))"
_mis = f"(coalesce(c.legal_area <> {_area('r.legal_area')}, false)::INT + coalesce(c.doc_type <> {_kind('r.doc_type')}, false)::INT + {_plenary}::INT + {_sector_mis}::INT)"
_inc = f"((c.legal_area IS NOT NULL AND {_area('r.legal_area')} IS NULL)::INT + (c.doc_type IS NOT NULL AND {_kind('r.doc_type')} IS NULL)::INT + (c.division IS NOT NULL AND NOT {_plenary})::INT + (c.sector IS NOT NULL AND {_sect} IS NULL AND NOT {_sector_mis})::INT)"
PREFIX = """, hits AS (SELECT p.namespace, p.prefix, r.ecli AS hit, r.court, r.year AS r_year, r.number AS r_number, r.legal_area AS r_area, r.doc_type AS r_type, row_number() OVER (PARTITION BY p.namespace, p.prefix ORDER BY r.ecli) AS place
  FROM (SELECT DISTINCT namespace, prefix FROM routed WHERE prefix IS NOT NULL{0}) p JOIN reg r ON r.namespace = p.namespace AND split_part(r.ecli, ':', 4) = split_part(p.prefix, ':', 4) AND starts_with(r.ecli, p.prefix) QUALIFY place <= 25)
"""
RESOLVED = PARTS + PREFIX.format(" AND method = 'prefix'") + f""", keep AS (SELECT citation_id, score_id, task_id, text, namespace, ecli, method, target, prefix, year, number, legal_area, doc_type, division, sector FROM routed),
x AS (SELECT c.*, r.ecli AS hit, {_mis} AS mis, {_inc} AS inc FROM keep c LEFT JOIN reg r ON r.ecli = c.target AND r.namespace = c.namespace WHERE method IN ('exact_ecli', 'constructed_ecli')),
cand AS (SELECT c.*, unnest(CASE c.legal_area WHEN 'CIV' THEN ['CIV', 'PEN'] WHEN 'PEN' THEN ['PEN', 'CIV'] ELSE ['CIV', 'PEN'] END) AS suffix FROM keep c WHERE method = 'cassation'),
cj AS (SELECT c.*, c.legal_area IS NULL OR c.suffix = c.legal_area AS asked, r.ecli AS hit, {_mis} AS mis, {_inc} AS inc FROM cand c LEFT JOIN reg r ON r.ecli = 'ECLI:IT:CASS:' || c.year || ':' || c.number || c.suffix AND r.namespace = 'CASS'),
cc AS (SELECT citation_id, any_value(score_id) AS score_id, any_value(task_id) AS task_id, any_value(text) AS text, any_value(namespace) AS namespace, any_value(year) AS year, any_value(number) AS number, any_value(legal_area) AS legal_area,
  count(*) FILTER (asked AND hit IS NOT NULL) AS n, count(*) FILTER (asked AND hit IS NOT NULL AND mis = 0 AND inc = 0) AS n_clean, count(*) FILTER (asked AND hit IS NOT NULL AND mis = 0) AS n_coherent, count(*) FILTER (NOT asked AND hit IS NOT NULL) AS n_homonyms,
  count(*) FILTER (asked AND hit IS NOT NULL AND mis > 0) AS n_mismatch, max(hit) FILTER (asked AND mis = 0 AND inc = 0) AS clean, max(hit) FILTER (asked AND mis = 0) AS coherent, max(hit) FILTER (asked) AS anyhit FROM cj GROUP BY citation_id),
pj AS (SELECT c.citation_id, any_value(c.score_id) AS score_id, any_value(c.task_id) AS task_id, any_value(c.text) AS text, any_value(c.namespace) AS namespace, count(*) FILTER (fit) AS n, max(hit) FILTER (fit) AS hit
  FROM (SELECT c.*, h.hit, coalesce(upper(regexp_replace(h.court, '[^A-Za-z0-9]', '', 'g')) = c.namespace AND c.year = h.r_year AND c.number = CAST(h.r_number AS VARCHAR) AND (c.doc_type IS NULL OR coalesce(c.doc_type = {_kind('h.r_type')}, false)) AND (c.legal_area IS NULL OR coalesce(c.legal_area = {_area('h.r_area')}, false)), false) AS fit
        FROM keep c LEFT JOIN hits h ON h.namespace = c.namespace AND h.prefix = c.prefix WHERE c.method = 'prefix') c GROUP BY c.citation_id),
resolved AS (
  SELECT citation_id, score_id, task_id, text, ecli, 'outside' AS method, 'outside_index_scope' AS status, 'unknown' AS accuracy, NULL::VARCHAR AS matched, 0 AS candidates, []::VARCHAR[] AS requested FROM keep WHERE method = 'outside'
  UNION ALL SELECT citation_id, score_id, task_id, text, ecli, 'insufficient', 'insufficient_data', 'incomplete', NULL, 0, [] FROM keep WHERE method = 'insufficient'
  UNION ALL SELECT citation_id, score_id, task_id, text, ecli, method, CASE WHEN hit IS NULL THEN 'not_found' ELSE 'resolved' END, CASE WHEN hit IS NULL THEN 'unknown' WHEN mis > 0 THEN 'metadata_mismatch' WHEN inc > 0 THEN 'incomplete' ELSE 'exact' END, hit, (hit IS NOT NULL)::INT, [target] FROM x
  UNION ALL SELECT citation_id, score_id, task_id, text, NULL, 'cass_exact_ecli_candidates', CASE WHEN n = 0 THEN 'not_found' WHEN n_clean = 1 OR n_coherent = 1 OR n = 1 THEN 'resolved' ELSE 'ambiguous' END,
    CASE WHEN n = 0 THEN CASE WHEN n_homonyms > 0 THEN 'metadata_mismatch' ELSE 'unknown' END WHEN n_clean = 1 THEN 'exact' WHEN n_coherent = 1 THEN 'incomplete' WHEN n_mismatch > 0 THEN 'metadata_mismatch' ELSE 'incomplete' END,
    CASE WHEN n_clean = 1 THEN clean WHEN n_coherent = 1 THEN coherent WHEN n = 1 THEN anyhit END, CASE WHEN n_clean = 1 OR n_coherent = 1 THEN 1 ELSE n END,
    CASE WHEN legal_area IS NULL THEN ['ECLI:IT:CASS:' || year || ':' || number || 'CIV', 'ECLI:IT:CASS:' || year || ':' || number || 'PEN'] ELSE ['ECLI:IT:CASS:' || year || ':' || number || legal_area] END FROM cc
  UNION ALL SELECT citation_id, score_id, task_id, text, NULL, 'prefix_metadata', CASE WHEN n = 0 THEN 'not_found' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END, CASE WHEN n = 0 THEN 'unknown' WHEN n = 1 THEN 'exact' ELSE 'incomplete' END, CASE WHEN n = 1 THEN hit END, n, [] FROM pj),
final AS (SELECT *, CASE WHEN status IN ('not_found', 'insufficient_data') THEN 'not_found_in_index' WHEN status = 'ambiguous' THEN 'ambiguous_local_registry' WHEN status = 'resolved' THEN 'resolved_local_registry_' || accuracy ELSE status END AS final_status FROM resolved)
"""
_PROFILES = f"""profiles AS (SELECT task_id, ecli, bool_or(resolving) AS resolving FROM (SELECT task_id, {_CANON.format('source_ecli')} AS ecli, true AS resolving FROM benchmark_tasks
  UNION ALL SELECT a.task_id, {_CANON.format('c.ecli')}, false FROM registry_candidates c JOIN (SELECT DISTINCT citation_id, task_id FROM citations) a USING (citation_id) WHERE c.confidence = 'high') WHERE ecli IS NOT NULL GROUP BY ALL)
"""
_credit = "(f.final_status IN ('resolved_local_registry_exact', 'resolved_local_registry_incomplete') AND f.matched IS NOT NULL)"
_court = "split_part(coalesce(f.requested[1], f.ecli), ':', 3)"
GROUNDED = RESOLVED + "," + _PROFILES + f""", grounded AS (SELECT f.citation_id, f.score_id, f.task_id, f.final_status, CASE WHEN {_credit} AND p.resolving THEN 'issue_aligned' WHEN {_credit} AND p.ecli IS NOT NULL THEN 'retrieved_only' WHEN {_credit} THEN 'outside_profile'
  WHEN f.final_status = 'not_found_in_index' AND NOT coalesce(({_court} IS NOT NULL AND {_court} <> '' AND pl.place IS NULL) OR (coalesce(f.requested[1], f.ecli) IS NULL AND regexp_matches(f.text, '(?i)\\b(Trib\\.|Tribunale|App\\.|Corte d[''’]appello|Corte di appello)')), false) THEN 'fabricated_or_not_found' ELSE 'unresolved' END AS relation,
  CASE WHEN f.final_status <> 'not_found_in_index' THEN NULL WHEN {_court} <> '' AND pl.place IS NULL THEN 'court_not_in_registry' WHEN {_court} = 'CASS' AND (SELECT count(*) FROM years) > 0 AND CAST(split_part(coalesce(f.requested[1], f.ecli), ':', 4) AS INT) NOT IN (SELECT year FROM years) THEN 'year_poorly_covered'
    WHEN coalesce(f.requested[1], f.ecli) IS NULL AND regexp_matches(f.text, '(?i)\\b(Trib\\.|Tribunale|App\\.|Corte d[''’]appello|Corte di appello)') THEN 'merit_court_without_identifier' END AS note
  FROM final f LEFT JOIN profiles p ON p.task_id = f.task_id AND p.ecli = f.matched LEFT JOIN places pl ON pl.place = {_court})
"""
_HIST = "count(*) AS citations_total, " + ", ".join(f"count(*) FILTER (relation = '{r}') AS {r}" for r in res.RELATIONS)
GOG = GROUNDED + f""", rec AS (SELECT task_id, score_id, {_HIST} FROM grounded GROUP BY ALL), last AS (SELECT *, count(*) OVER () AS records, sum(citations_total) OVER () AS t, sum(issue_aligned) OVER () AS a FROM rec QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY score_id DESC) = 1)
SELECT round(sum(coalesce(issue_aligned / nullif(citations_total, 0), 0)) / DENOMINATOR, 6) AS gog, round(count(*) FILTER (issue_aligned > 0) / DENOMINATOR, 6) AS coverage, CAST(DENOMINATOR AS BIGINT) AS tasks_total, any_value(records) AS tasks_reported, CAST(any_value(t) AS BIGINT) AS citations_total, CAST(any_value(a) AS BIGINT) AS issue_aligned FROM last"""
ORACLE = {
    "registry_current": REG + "SELECT * FROM reg",
    "registry_stats": REG + "SELECT namespace, count(*) AS n, count(DISTINCT court) AS courts, min(year) AS first_year, max(year) AS last_year FROM reg GROUP BY ALL",
    "registry_coverage_years": REG + "SELECT year, count(*) AS n, count(*) >= 1000 AS covered FROM reg WHERE namespace = 'CASS' GROUP BY ALL",
    "registry_places": REG + "SELECT place FROM places",
    "citation_components": PARTS + "SELECT * EXCLUDE (text) FROM parts",
    "citation_routes": PARTS + "SELECT namespace, method, count(*) AS n, count(target) AS with_target, count(prefix) AS with_prefix FROM routed GROUP BY ALL",
    "prefix_topk": PARTS + PREFIX.format("") + "SELECT namespace, prefix, hit, place FROM hits",
    "resolution_states": RESOLVED + "SELECT citation_id, method, status, accuracy, matched, CAST(candidates AS INT) AS candidates, final_status FROM final",
    "resolution_counts": RESOLVED + "SELECT method, status, accuracy, final_status, count(*) AS n FROM final GROUP BY ALL",
    "status_histogram": RESOLVED + "SELECT s AS final_status, count(f.final_status) AS n FROM (SELECT unnest([" + ", ".join(f"'{s}'" for s in res.STATUSES) + "]) AS s) LEFT JOIN final f ON f.final_status = s GROUP BY s",
    "report_summary": RESOLVED + "SELECT score_id, count(*) AS citations, count(DISTINCT coalesce(nullif(array_to_string(list_sort(requested), '|'), ''), ecli, text)) AS distinct_keys, count(*) FILTER (status = 'resolved') AS resolved, bool_or(final_status = 'not_found_in_index') AS hard_fail FROM final GROUP BY score_id",
    "citation_relations": GROUNDED + "SELECT citation_id, final_status, relation FROM grounded",
    "sector_conflicts": PARTS + f"""SELECT c.sector, c.division, {_sect} AS r_sector,
  concat_ws('+', CASE WHEN c.legal_area <> {_area('r.legal_area')} THEN 'legalArea' END, CASE WHEN c.doc_type <> {_kind('r.doc_type')} THEN 'docType' END, CASE WHEN {_sector_mis} THEN 'sector' END, CASE WHEN {_plenary} THEN 'division' END) AS mismatch,
  concat_ws('+', CASE WHEN c.legal_area IS NOT NULL AND {_area('r.legal_area')} IS NULL THEN 'legalArea' END, CASE WHEN c.doc_type IS NOT NULL AND {_kind('r.doc_type')} IS NULL THEN 'docType' END, CASE WHEN c.sector IS NOT NULL AND {_sect} IS NULL AND NOT {_sector_mis} THEN 'sector' END, CASE WHEN c.division IS NOT NULL AND NOT {_plenary} THEN 'division' END) AS incomplete, count(*) AS n
FROM routed c JOIN reg r ON r.ecli = c.target AND r.namespace = c.namespace WHERE c.method IN ('exact_ecli', 'constructed_ecli') GROUP BY ALL""",
    "coverage_notes": GROUNDED + "SELECT relation, note, count(*) AS n FROM grounded WHERE final_status = 'not_found_in_index' GROUP BY ALL",
    "citation_relation_hist": GROUNDED + f"SELECT {_HIST} FROM grounded",
    "grounding_by_task": GROUNDED + f"SELECT task_id, score_id, {_HIST} FROM grounded GROUP BY ALL",
    "grounding_gog_coverage": GOG.replace("DENOMINATOR", "any_value(records)"),
    "grounding_fixed_tasks": GOG.replace("DENOMINATOR", "67"),
    "profile_sizes": "WITH " + _PROFILES + "SELECT task_id, count(*) FILTER (resolving) AS resolving, count(*) AS retrieved FROM profiles GROUP BY task_id",
    "coverage_namespaces": PARTS + "SELECT split_part(ecli, ':', 3) AS place, count(*) AS citations, bool_or(pl.place IS NOT NULL) AS covered FROM parts LEFT JOIN places pl ON pl.place = split_part(ecli, ':', 3) WHERE ecli IS NOT NULL GROUP BY 1",
}
