"""Queries over proposed citations, replies of models and judges, and their coercion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from giurispark.functions import ecli, text
from giurispark.operators import consensus, extraction, matching, usage
from giurispark.plans.references import _CANON
from giurispark.sources.tables import table

# ---- proposed citations ------------------------------------------------------------------

_RAW = ["score_id", "text", "ecli", "suggested_namespace", "number", "year", "legal_area", "extraction_method"]


def _items(spark: SparkSession, base: str) -> DataFrame:
    """One proposal per citation: of rows that differ the greatest, whole."""
    one = table(spark, base, "citations").groupBy("citation_id").agg(F.max(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _RAW])).alias("r"))
    r = {c: ecli.nonempty(F.col(f"r.{c}")) for c in _RAW}
    rows = one.select(F.col("citation_id").alias("item"), r["score_id"].cast("long").alias("id"), r["text"].alias("raw"), r["ecli"].alias("ecli"), r["suggested_namespace"].alias("namespace"), r["number"].alias("number"), r["year"].alias("year"), r["legal_area"].alias("area"), r["extraction_method"].alias("method"))
    return rows.join(table(spark, base, "task_scores").select(F.col("score_id").alias("id"), F.col("model_output").alias("source")), "id")


def _parsed(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "citations").where("extraction_method = 'regex'")
    return rows.select(
        F.col("score_id").alias("id"), ecli.number(F.col("number")).alias("number"), "year", ecli.namespace_for(ecli.canonical(F.col("ecli")), F.col("suggested_namespace")).alias("namespace"),
        F.col("outside_index_scope").alias("outside"), F.col("span_start").alias("start"), F.col("span_end").alias("end"),
    ).distinct()


def _laddered(spark: SparkSession, base: str) -> DataFrame:
    return extraction.ladder(_items(spark, base), _parsed(spark, base))


def raw_text_ladder(spark: SparkSession, base: str) -> DataFrame:
    """Where each proposed text stands in its answer, or why it is discarded."""
    return _laddered(spark, base).select(F.col("item").alias("citation_id"), "category", "reason", "start", "end")


def item_warnings(spark: SparkSession, base: str) -> DataFrame:
    """What is wrong with each accepted proposal."""
    kept = _laddered(spark, base).where("reason IS NULL")
    warnings = extraction.item_warnings(F.col("raw"), F.col("namespace"), F.col("ecli"), F.col("number"), F.col("year"), F.col("area"), F.col("category"))
    return kept.select(F.col("item").alias("citation_id"), F.array_join(warnings, "|").alias("warnings"))


def extractor_diagnostics(spark: SparkSession, base: str) -> DataFrame:
    """Accepted and discarded proposals by channel."""
    return extraction.validation_counts(_laddered(spark, base), "method")


def warnings_merged(spark: SparkSession, base: str) -> DataFrame:
    """Different warnings of each answer, in order; a text holds few."""
    kept = _laddered(spark, base).where("reason IS NULL")
    warnings = extraction.item_warnings(F.col("raw"), F.col("namespace"), F.col("ecli"), F.col("number"), F.col("year"), F.col("area"), F.col("category"))
    return kept.groupBy(F.col("id").alias("score_id")).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(warnings)))), "|").alias("warnings"))


def supported_sources(spark: SparkSession, base: str) -> DataFrame:
    """Per answer the citations of supported courts, of sources outside the index, and with an identifier."""
    rows = table(spark, base, "citations", "citation_id", "score_id", "suggested_namespace", "outside_index_scope", "ecli").distinct()
    space = F.upper(ecli.strip(F.col("suggested_namespace"))).isin(*ecli.SUPPORTED_NAMESPACES)
    counted = F.coalesce(space, F.lit(False)) | F.coalesce("outside_index_scope", F.lit(False)) | F.col("ecli").isNotNull()
    return rows.groupBy("score_id").agg(F.count("*").alias("proposed"), F.count_if(counted).alias("supported"))


def citation_records(spark: SparkSession, base: str) -> DataFrame:
    """Candidates as JSON records with fixed keys, nulls spelled out."""
    fields = ["candidate_id", "citation_id", "namespace", "ecli", "confidence", "year", "citation_number", "legal_area", "resolution_method"]
    return table(spark, base, "registry_candidates").select("candidate_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))


# ---- replies -----------------------------------------------------------------------------


def _replies(spark: SparkSession, base: str) -> DataFrame:
    """Votes as judges would send them: a JSON object, fenced or among words."""
    votes = table(spark, base, "judge_votes", "score_id", "criterion_id", "judge_id", "verdict", "reasoning").distinct()
    body = F.to_json(F.struct("verdict", "reasoning"))
    judge = F.upper(ecli.strip(F.col("judge_id")))
    return votes.withColumn("reply", F.when(judge == "A", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(judge == "B", F.concat(F.lit("Ecco: "), body)).otherwise(body))


def reply_decisions(spark: SparkSession, base: str) -> DataFrame:
    """Verdicts and reasons read back from replies; what is no pass or fail is an error."""
    decided = consensus.coerced(F.col("reply"))
    return _replies(spark, base).select(*[v.alias(k) for k, v in decided.items()]).groupBy("decision", "decision_status", "decision_reasoning").agg(F.count("*").alias("n"))


def criteria_parsed(spark: SparkSession, base: str) -> DataFrame:
    """Criteria read back from a generated list: titled and matchable ones, at most four, numbered anew."""
    rows = table(spark, base, "benchmark_tasks", "task_id", "criteria")
    reply = F.concat(F.lit("```json\n"), F.to_json(F.transform(F.concat("criteria", "criteria"), lambda c: F.struct(c["title"].alias("title"), c["match_criteria"].alias("match_criteria")))), F.lit("\n```"))
    return rows.select("task_id", F.inline(matching.parsed_criteria(reply))).select("task_id", "id", "title", "match_criteria")


def consensus_sentences(spark: SparkSession, base: str) -> DataFrame:
    """Verdicts of the panel in words, by how often."""
    decided = consensus.decide(consensus.panel(consensus.last_votes(table(spark, base, "judge_votes"), ["score_id", "criterion_id"]), ["score_id", "criterion_id"]))
    return decided.groupBy(consensus.explained(decided).alias("sentence")).agg(F.count("*").alias("n"))


def votes_completed(spark: SparkSession, base: str) -> DataFrame:
    """Votes of both first judges on every recorded criterion; one that was not cast is an error."""
    items = table(spark, base, "criterion_results", "score_id", "criterion_id").distinct()
    votes = consensus.last_votes(table(spark, base, "judge_votes"), ["score_id", "criterion_id"])
    return consensus.completed(items, votes, ["score_id", "criterion_id"]).groupBy("judge", "status", "verdict").agg(F.count("*").alias("n"))


def criteria_adapted(spark: SparkSession, base: str) -> DataFrame:
    """Every criterion of every answered task with its verdict, unresolved where none is recorded."""
    tasks = table(spark, base, "benchmark_tasks").select("task_id", F.explode("criteria.id").alias("criterion_id"))
    asked = table(spark, base, "task_scores", "score_id", "task_id").join(tasks, "task_id").select("score_id", "criterion_id").distinct()
    given = table(spark, base, "criterion_results", "score_id", "criterion_id", "verdict").groupBy("score_id", "criterion_id").agg(F.min("verdict").alias("verdict"))
    return consensus.adapted(asked, given, ["score_id", "criterion_id"], "unresolved").groupBy("score_id").agg(F.count("*").alias("criteria"), F.count_if(F.col("verdict") == "unresolved").alias("unresolved"))


# ---- usage and selections ----------------------------------------------------------------


def usage_tokens(spark: SparkSession, base: str) -> DataFrame:
    """Token counts read from usage records as each provider spells them, by model."""
    rows = table(spark, base, "task_scores").select("model", "model_call_provider", F.col("model_call_input_tokens").alias("i"), F.col("model_call_output_tokens").alias("o"))
    names = [("input_tokens", "output_tokens"), ("prompt_tokens", "completion_tokens"), ("prompt_token_count", "candidates_token_count"), ("inputTokens", "outputTokens")]
    kind = F.pmod(F.length(F.coalesce("model_call_provider", F.lit(""))), F.lit(len(names)))
    record = F.coalesce(*[F.when(kind == k, F.to_json(F.struct(F.col("i").alias(a), F.col("o").alias(b)))) for k, (a, b) in enumerate(names)])
    counted = rows.select("model", usage.tokens(record, usage.INPUT).alias("i"), usage.tokens(record, usage.OUTPUT).alias("o"))
    return counted.groupBy("model").agg(F.count("*").alias("calls"), F.coalesce(F.sum("i"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("o"), F.lit(0)).alias("output_tokens"), F.count("i").alias("with_input"))


def area_tasks(spark: SparkSession, base: str) -> DataFrame:
    """False-premise tasks of one area: by the area as written or by the id's first part, whatever the case."""
    return matching.of_area(table(spark, base, "benchmark_tasks", "task_id", "task_type", "macro_area"), "Diritto_Civile").select("task_id", "macro_area")


def sample_all(spark: SparkSession, base: str) -> DataFrame:
    """A sample of size 0 is everything, in the order of ids."""
    return matching.sampled_sorted(table(spark, base, "benchmark_tasks", "task_id"), "task_id", 0, 42)


def sample_sorted(spark: SparkSession, base: str) -> DataFrame:
    """Fifteen tasks by seed, in the order of ids."""
    return matching.sampled_sorted(table(spark, base, "benchmark_tasks", "task_id"), "task_id", 15, 42)


def answers_without_header(spark: SparkSession, base: str) -> DataFrame:
    """Answers as an export writes them, dated, and without that line again; lengths tell that nothing else is lost."""
    rows = table(spark, base, "task_scores", "score_id", "model_output", "scored_at").where("model_output IS NOT NULL")
    dated = F.concat(F.lit("[03/12/2024, 10:15] - "), "model_output")
    return rows.select("score_id", F.length(text.without_export_header(dated)).alias("left"), (text.without_export_header(dated) == ecli.strip(F.col("model_output"))).alias("whole"))


QUERIES = {f.__name__: f for f in (
    raw_text_ladder, item_warnings, extractor_diagnostics, warnings_merged, supported_sources, citation_records, reply_decisions, criteria_parsed, consensus_sentences, votes_completed, criteria_adapted,
    usage_tokens, area_tasks, sample_all, sample_sorted, answers_without_header,
)}

WS = "E' \\t\\n\\r'"
_S = r"[\s\x{A0}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_strip = lambda c: f"regexp_replace(regexp_replace({c}, '^{_S}+', ''), '{_S}+$', '')"
_num = lambda c: f"(CASE WHEN regexp_full_match(trim({c}, {WS}), '[0-9]+') THEN coalesce(nullif(ltrim(trim({c}, {WS}), '0'), ''), '0') END)"
_plain = lambda c: f"trim(regexp_replace(translate({c}, '‘’“”–—' || chr(160), '''''\"\"-- '), '{_S}+', ' ', 'g'))"
_space = "CASE WHEN split_part({0}, ':', 2) = 'IT' THEN CASE WHEN split_part({0}, ':', 3) IN ('CASS', 'COST', 'CONT', 'ABF', 'COVIP') THEN split_part({0}, ':', 3) WHEN split_part({0}, ':', 3) = 'CDS' OR starts_with(split_part({0}, ':', 3), 'TAR') THEN 'ADM' WHEN split_part({0}, ':', 3)[:3] IN ('CG1', 'CG2') THEN 'TAX' WHEN split_part({0}, ':', 3)[:2] IN ('CA', 'TR') THEN 'MER' END END"
_SUPPORTED = "('CASS', 'MER', 'ADM', 'COST', 'CONT', 'TAX', 'ABF', 'COVIP')"
ITEMS = "WITH best AS (SELECT citation_id, max({" + ", ".join(f"'{c}': coalesce(CAST({c} AS VARCHAR), '')" for c in _RAW) + f"""}}) AS r FROM citations GROUP BY citation_id),
items AS (SELECT citation_id, CAST(r.score_id AS BIGINT) AS id, nullif({_strip('r.text')}, '') AS raw, nullif(r.ecli, '') AS ecli, upper({_strip("nullif(r.suggested_namespace, '')")}) AS namespace, nullif(r.number, '') AS raw_number, nullif(r.year, '') AS raw_year, nullif(r.legal_area, '') AS area, r.extraction_method AS method, s.model_output AS source FROM best JOIN task_scores s ON s.score_id = CAST(r.score_id AS BIGINT)),
known AS (SELECT *, coalesce({_num('raw_number')}, {_num("regexp_extract(raw, '(?i)(?:n[.]|num[.]|numero)[ ]*([0-9]+) *(?:/| +del +) *[0-9]{{4}}', 1)")}, {_num("regexp_extract(raw, '([0-9]+) */ *[0-9]{{4}}', 1)")}) AS number,
  coalesce(CASE WHEN regexp_full_match(raw_year, '[1-9][0-9]{{3}}') THEN CAST(raw_year AS INT) END, TRY_CAST(regexp_extract(raw, '(?i)(?:n[.]|num[.]|numero) *[0-9]+ *(?:/| +del +) *([1-9][0-9]{{3}})', 1) AS INT), TRY_CAST(regexp_extract(raw, '[0-9]+ */ *([1-9][0-9]{{3}})', 1) AS INT)) AS year FROM items),
parsed AS (SELECT DISTINCT score_id AS id, {_num('number')} AS number, year, coalesce({_space.format('k')}, CASE WHEN upper(trim(suggested_namespace, {WS})) IN {_SUPPORTED} THEN upper(trim(suggested_namespace, {WS})) END) AS namespace, coalesce(outside_index_scope, false) AS outside, span_start AS s, span_end AS e
  FROM (SELECT *, {_CANON.format('ecli')} AS k FROM citations WHERE extraction_method = 'regex')),
spans AS (SELECT citation_id, count(DISTINCT {{'s': p.s, 'e': p.e}}) AS spans, min({{'s': p.s, 'e': p.e}}) AS span FROM known k JOIN parsed p ON k.id = p.id AND k.number = p.number AND k.year = p.year AND (k.namespace IS NULL OR CASE WHEN k.namespace IN ('CEDU', 'CGUE') THEN p.outside ELSE coalesce(p.namespace, '') = k.namespace END) GROUP BY 1),
places AS (SELECT k.*, spans, span, (length({_plain("coalesce(source, '')")}) - length(replace({_plain("coalesce(source, '')")}, {_plain('raw')}, ''))) // nullif(length({_plain('raw')}), 0) AS n FROM known k LEFT JOIN spans USING (citation_id)),
ladder AS (SELECT *, CASE WHEN raw IS NULL THEN 'raw_text_missing' WHEN contains(source, raw) THEN 'raw_text_exact' WHEN n = 1 THEN 'raw_text_normalized_match' WHEN n > 1 THEN 'raw_text_ambiguous_in_source' WHEN number IS NULL OR year IS NULL THEN 'raw_text_not_verbatim'
  WHEN NOT coalesce(regexp_matches(source, '(^|[^0-9])0*' || number || '([^0-9]|$)') AND regexp_matches(source, '(^|[^0-9])' || year || '([^0-9]|$)'), false) THEN 'raw_text_identifier_not_in_source' WHEN spans = 1 THEN 'raw_text_recovered_by_unique_identifier' WHEN spans > 1 THEN 'raw_text_ambiguous_in_source' ELSE 'raw_text_not_verbatim' END AS category FROM places),
told AS (SELECT *, CASE WHEN category = 'raw_text_missing' THEN category WHEN category IN ('raw_text_exact', 'raw_text_normalized_match', 'raw_text_recovered_by_unique_identifier') THEN NULL WHEN category = 'raw_text_ambiguous_in_source' THEN CASE WHEN n > 1 THEN 'multiple_typographic_matches' ELSE 'multiple_identifier_matches' END
  WHEN category = 'raw_text_identifier_not_in_source' THEN 'number_or_year_absent' WHEN number IS NULL OR year IS NULL THEN 'missing_number_or_year' ELSE 'no_compatible_span' END AS reason FROM ladder),
warned AS (SELECT citation_id, id, list_filter([CASE WHEN category <> 'raw_text_exact' THEN 'raw_text_recovery=' || category END, CASE WHEN namespace NOT IN {_SUPPORTED} AND namespace NOT IN ('CEDU', 'CGUE') THEN 'invalid_jurisdiction_type=' || namespace END,
  CASE WHEN NOT contains(upper(raw), upper({_strip('ecli')})) THEN 'explicit_ecli_not_in_raw_text' WHEN NOT regexp_full_match(upper({_strip('ecli')}), 'ECLI:IT:[A-Z0-9]+:[0-9]{{4}}:[A-Z0-9.]+') THEN 'invalid_explicit_ecli' END,
  CASE WHEN NOT regexp_full_match(raw_year, '[1-9][0-9]{{3}}') THEN 'invalid_year=' || raw_year END, CASE WHEN raw_number IS NOT NULL AND {_num('raw_number')} IS NULL THEN 'invalid_number=' || raw_number END,
  CASE WHEN area IS NOT NULL AND NOT coalesce(CASE WHEN rtrim(upper(trim(area)), '.') IN ('CIV', 'CIVILE') THEN regexp_matches(raw, '(?i)\\bciv') WHEN rtrim(upper(trim(area)), '.') IN ('PEN', 'PENALE') THEN regexp_matches(raw, '(?i)\\bpen') END, false) THEN 'legal_area_not_explicit' END,
  CASE WHEN NOT coalesce(contains(upper(raw), upper({_strip('ecli')})) AND regexp_full_match(upper({_strip('ecli')}), 'ECLI:IT:[A-Z0-9]+:[0-9]{{4}}:[A-Z0-9.]+') AND ({_space.format('upper(' + _strip('ecli') + ')')}) IS NOT NULL, false) AND NOT coalesce(namespace IN {_SUPPORTED} OR namespace IN ('CEDU', 'CGUE'), false) THEN 'missing_supported_namespace' END],
  lambda w: w IS NOT NULL) AS w FROM told WHERE reason IS NULL)
"""
_VOTES = f"SELECT DISTINCT score_id, criterion_id, upper(trim(judge_id, {WS})) AS judge, lower(trim(verdict, {WS})) AS verdict, status, model, voted_at FROM judge_votes WHERE judge_id IS NOT NULL"
LAST = f"WITH last AS (SELECT score_id, criterion_id, judge, arg_max({{'v': verdict, 's': status}}, {{'at': voted_at, 's': status, 'v': coalesce(verdict, ''), 'm': model}}) AS x FROM ({_VOTES}) GROUP BY ALL), votes AS (SELECT score_id, criterion_id, judge, x.v AS verdict, x.s = 'ok' AND coalesce(x.v IN ('pass', 'fail'), false) AS valid FROM last)\n"
PANEL = LAST + """, p AS (SELECT score_id, criterion_id, max(verdict) FILTER (judge = 'A' AND valid) AS a, max(verdict) FILTER (judge = 'B' AND valid) AS b, max(verdict) FILTER (judge = 'C' AND valid) AS c FROM votes GROUP BY ALL),
d AS (SELECT CASE WHEN a = b THEN 'initial_agreement' WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN 'tie_breaker' WHEN (a IS NULL) <> (b IS NULL) AND c = coalesce(a, b) THEN 'recovery_agreement' ELSE 'unresolved' END AS method, a, b, c FROM p)
"""
ORACLE = {
    "raw_text_ladder": ITEMS + "SELECT citation_id, category, reason, CASE WHEN category = 'raw_text_recovered_by_unique_identifier' THEN span.s END AS start, CASE WHEN category = 'raw_text_recovered_by_unique_identifier' THEN span.e END AS \"end\" FROM told",
    "item_warnings": ITEMS + "SELECT citation_id, array_to_string(w, '|') AS warnings FROM warned",
    "extractor_diagnostics": ITEMS + "SELECT method, count(*) AS proposed, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS discarded, " + ", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in extraction.LADDER) + ", CASE WHEN count(*) FILTER (reason IS NULL) = 0 THEN 'all_discarded' END AS empty_result FROM told GROUP BY method",
    "warnings_merged": ITEMS + "SELECT id AS score_id, array_to_string(list_sort(list_distinct(flatten(list(w)))), '|') AS warnings FROM warned GROUP BY id",
    "supported_sources": f"SELECT score_id, count(*) AS proposed, count(*) FILTER (coalesce(upper(trim(suggested_namespace, {WS})) IN {_SUPPORTED}, false) OR coalesce(outside_index_scope, false) OR ecli IS NOT NULL) AS supported FROM (SELECT DISTINCT citation_id, score_id, suggested_namespace, outside_index_scope, ecli FROM citations) GROUP BY 1",
    "citation_records": "SELECT candidate_id, CAST(to_json({" + ", ".join(f"'{c}': {c}" for c in ("candidate_id", "citation_id", "namespace", "ecli", "confidence", "year", "citation_number", "legal_area", "resolution_method")) + "}) AS VARCHAR) AS record FROM registry_candidates",
    "reply_decisions": f"SELECT CASE WHEN lower(trim(verdict, {WS})) IN ('pass', 'fail') THEN lower(trim(verdict, {WS})) END AS decision, CASE WHEN coalesce(lower(trim(verdict, {WS})) IN ('pass', 'fail'), false) THEN 'ok' ELSE 'error' END AS decision_status, reasoning AS decision_reasoning, count(*) AS n FROM (SELECT DISTINCT score_id, criterion_id, judge_id, verdict, reasoning FROM judge_votes) GROUP BY ALL",
    "criteria_parsed": "SELECT task_id, format('C-{:03d}', i) AS id, trim(c[i].title) AS title, trim(c[i].match_criteria) AS match_criteria FROM (SELECT task_id, c, unnest(range(1, least(4, len(c)) + 1)) AS i FROM (SELECT task_id, list_filter(list_concat(criteria, criteria), lambda c: trim(coalesce(c.title, '')) <> '' AND trim(coalesce(c.match_criteria, '')) <> '') AS c FROM benchmark_tasks))",
    "consensus_sentences": PANEL + """SELECT CASE method WHEN 'unresolved' THEN 'Verdetto UNRESOLVED: non esistono due voti validi concordi.' WHEN 'initial_agreement' THEN 'Verdetto ' || upper(a) || ' sostenuto da Judge A e Judge B con consenso iniziale.'
  WHEN 'tie_breaker' THEN 'Verdetto ' || upper(c) || ' sostenuto da Judge ' || CASE WHEN a = c THEN 'A' ELSE 'B' END || ' e Judge C dopo attivazione del tie-breaker.' ELSE 'Verdetto ' || upper(c) || ' sostenuto da Judge ' || CASE WHEN a IS NOT NULL THEN 'A' ELSE 'B' END || ' e Judge C dopo attivazione del recovery judge.' END AS sentence, count(*) AS n FROM d GROUP BY 1""",
    "votes_completed": LAST + "SELECT j.judge, CASE WHEN v.valid IS NULL THEN 'missing' WHEN v.valid THEN 'ok' ELSE 'error' END AS status, CASE WHEN v.valid THEN v.verdict END AS verdict, count(*) AS n FROM (SELECT DISTINCT score_id, criterion_id, unnest(['A', 'B']) AS judge FROM criterion_results) j LEFT JOIN votes v USING (score_id, criterion_id, judge) GROUP BY ALL",
    "criteria_adapted": "WITH asked AS (SELECT DISTINCT score_id, unnest(list_transform(criteria, lambda c: c.id)) AS criterion_id FROM task_scores JOIN benchmark_tasks USING (task_id)), given AS (SELECT score_id, criterion_id, min(verdict) AS verdict FROM criterion_results GROUP BY ALL) SELECT score_id, count(*) AS criteria, count(*) FILTER (coalesce(verdict, 'unresolved') = 'unresolved') AS unresolved FROM asked LEFT JOIN given USING (score_id, criterion_id) GROUP BY 1",
    "usage_tokens": "SELECT model, count(*) AS calls, CAST(coalesce(sum(model_call_input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(model_call_output_tokens), 0) AS BIGINT) AS output_tokens, count(model_call_input_tokens) AS with_input FROM task_scores GROUP BY 1",
    "area_tasks": "SELECT task_id, macro_area FROM benchmark_tasks WHERE lower(coalesce(macro_area, '')) = 'diritto_civile' OR lower(split_part(task_id, '/', 1)) = 'diritto_civile'",
    "sample_all": "SELECT task_id FROM benchmark_tasks ORDER BY task_id",
    "sample_sorted": "SELECT task_id FROM (SELECT task_id FROM benchmark_tasks ORDER BY md5('42/' || task_id), task_id LIMIT 15) ORDER BY task_id",
    "answers_without_header": f"SELECT score_id, length({_strip('model_output')}) AS \"left\", true AS whole FROM task_scores WHERE model_output IS NOT NULL",
}
