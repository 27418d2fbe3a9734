"""Queries over text keys, citation text, matching, sampling and model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from giurispark.functions import ecli, text
from giurispark.operators import extraction, matching, usage
from giurispark.plans.references import _CANON
from giurispark.sources.tables import table

# ---- identifiers -------------------------------------------------------------------------


def ecli_normalise(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "citations", "ecli").distinct().select("ecli", ecli.canonical(F.col("ecli")).alias("canonical"))


def ecli_fields(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "registry", "ecli").select(ecli.canonical(F.col("ecli")).alias("ecli")).distinct()
    return rows.select("ecli", *[v.alias(k) for k, v in extraction.fields_of(F.col("ecli")).items()], ecli.part(F.col("ecli"), 2).alias("court"))


def namespace_infer(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "citations", "ecli", "suggested_namespace").distinct().withColumn("canonical", ecli.canonical(F.col("ecli")))
    return rows.groupBy("canonical", "suggested_namespace").agg(F.count("*").alias("n")).select(
        "canonical", "suggested_namespace", ecli.namespace_of(F.col("canonical")).alias("inferred"), ecli.namespace_of(F.col("canonical"), italian_only=False).alias("inferred_any"), ecli.namespace_for(F.col("canonical"), F.col("suggested_namespace")).alias("namespace")
    )


def number_normalise(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "citations", "number", "year").distinct().select("number", "year", ecli.number(F.col("number")).alias("plain"), ecli.padded_number(F.col("number")).alias("padded"), ecli.year(F.col("year")).alias("good_year"))


def code_normalise(spark: SparkSession, base: str) -> DataFrame:
    """Kinds, areas, courts and sectors of registry rows in their short forms."""
    from giurispark.operators.resolution import division, sector

    rows = table(spark, base, "registry", "doc_type", "legal_area", "court", "sector").distinct()
    return rows.select("doc_type", "legal_area", "court", "sector", ecli.doc_type(F.col("doc_type")).alias("kind"), ecli.legal_area(F.col("legal_area")).alias("area"), ecli.code(F.col("court")).alias("code"), sector(F.col("sector")).alias("plenary"), division(F.col("sector")).alias("division"))


def ecli_build(spark: SparkSession, base: str) -> DataFrame:
    """Identifiers built from the metadata of registry rows, and prefixes where the area is left out."""
    rows = table(spark, base, "registry", "namespace", "court", "year", "number", "legal_area", "doc_type").distinct()
    none = F.lit(None).cast("string")
    args = lambda area: (F.col("namespace"), F.col("year"), F.col("number"), area, F.col("court"), none, F.col("doc_type"), none)
    return rows.select("namespace", "court", "year", "number", "legal_area", "doc_type", ecli.exact(*args(F.col("legal_area"))).alias("built"), ecli.prefix(*args(none)).alias("start"))


def authority_codes(spark: SparkSession, base: str) -> DataFrame:
    """Court codes from names of authorities."""
    names = ["Tribunale di Milano", "Corte d'Appello di Reggio Calabria", "Corte di Appello di L’Aquila", "Consiglio di Stato", "TAR Lazio - Roma", "T.A.R. Veneto, Venezia", "Cassazione", "tribunale di nessundove", "Corte dei conti Torino"]
    rows = spark.createDataFrame([(n,) for n in names], "authority string")
    words = text.ascii_words(F.col("authority"))
    return rows.select("authority", words.alias("words"), ecli.authority_court(words, F.lit(None).cast("string")).alias("court"), ecli.venue(words).alias("venue"))


# ---- text in answers ---------------------------------------------------------------------


def _answers(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "task_scores").select(F.col("score_id").alias("id"), F.col("model_output").alias("text"))


def extract_identifiers(spark: SparkSession, base: str) -> DataFrame:
    found = _answers(spark, base).select("id", F.explode(extraction.identifiers(F.col("text"))).alias("ecli"))
    return found.groupBy("id", "ecli").agg(F.count("*").alias("mentions"))


def extract_numbers(spark: SparkSession, base: str) -> DataFrame:
    """Number/year pairs of composite references, one row each."""
    found = _answers(spark, base).select("id", F.explode(extraction.numbered(F.col("text"))).alias("pair"))
    return found.groupBy("pair").agg(F.count("*").alias("mentions"), F.countDistinct("id").alias("answers"))


def _extracted(spark: SparkSession, base: str) -> DataFrame:
    return extraction.extract(_answers(spark, base))


def extract_references(spark: SparkSession, base: str) -> DataFrame:
    """References of every channel with their spans."""
    return _extracted(spark, base)


def extract_channels(spark: SparkSession, base: str) -> DataFrame:
    return _extracted(spark, base).groupBy("channel", "namespace").agg(F.count("*").alias("n"), F.countDistinct("id").alias("answers"))


def extract_merged(spark: SparkSession, base: str) -> DataFrame:
    """All channels in one, merged by what they refer to; outside sources only of the European courts."""
    found = _extracted(spark, base).where("channel <> 'outside' OR namespace IN ('CEDU', 'CGUE')")
    keyed = found.withColumn("key", extraction.key(F.col("ecli"), F.col("namespace"), F.col("number"), F.col("year"), F.upper(F.substring("area", 1, 3)), F.col("text")))
    merged = extraction.merge(keyed, ["id", "key"], ["namespace", "authority", "area", "section", "kind", "number", "year", "ecli"], ["start", "end"], "channel")
    return merged.withColumns({"first_start": F.get("spans", F.lit(0))["start"], "n_spans": F.size("spans")}).drop("spans")


def fast_path(spark: SparkSession, base: str) -> DataFrame:
    """Answers whose references need no further look."""
    return extraction.fast_path(_answers(spark, base)).where("settled").select("id")


def extraction_check(spark: SparkSession, base: str) -> DataFrame:
    """Recorded citations against what stands in the answer at their span, by method."""
    spans = table(spark, base, "citations", "citation_id", "score_id", "text", "span_start", "span_end", "extraction_method").distinct()
    joined = spans.join(table(spark, base, "task_scores", "score_id", "model_output"), "score_id")
    at = F.substring("model_output", F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
    return joined.groupBy("extraction_method").agg(F.count("*").alias("n"), F.count_if(F.contains("model_output", F.col("text"))).alias("verbatim"), F.count_if(at == F.col("text")).alias("at_span"))


_MERGE = ["suggested_namespace", "number", "year", "legal_area", "section", "doc_type", "ecli"]


def citation_merge(spark: SparkSession, base: str) -> DataFrame:
    """Recorded citations of an answer that name the same source, in one row: first known value of every field in span order."""
    rows = table(spark, base, "citations").withColumns({"ecli": ecli.canonical(F.col("ecli")), "plain": ecli.number(F.col("number"))})
    keyed = rows.withColumn("key", extraction.key(F.col("ecli"), F.col("suggested_namespace"), F.col("plain"), F.col("year"), F.col("legal_area"), F.col("text")))
    return extraction.merge(keyed, ["score_id", "key"], _MERGE, ["span_start", "span_end", "citation_id"], "extraction_method").drop("spans")


def citation_keys(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "citations", "ecli", "suggested_namespace", "number", "year", "legal_area", "text").distinct()
    return rows.select("ecli", "suggested_namespace", "number", "year", "legal_area", "text", extraction.key(ecli.canonical(F.col("ecli")), F.col("suggested_namespace"), ecli.number(F.col("number")), F.col("year"), F.col("legal_area"), F.col("text")).alias("key"))


def _plain(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "citations").select("citation_id", F.col("score_id").alias("id"), "extraction_method", ecli.canonical(F.col("ecli")).alias("ecli"), F.col("suggested_namespace").alias("ns"), ecli.number(F.col("number")).alias("number"), "year", F.col("legal_area").alias("area"), F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    return rows.distinct()


def citation_links(spark: SparkSession, base: str) -> DataFrame:
    """Cassation citations without identifier and the link or other mention of the same answer that supplies it."""
    rows = _plain(spark, base)
    return extraction.linked(rows.where("ecli IS NULL AND ns = 'CASS'"), rows.where("ecli IS NOT NULL"))


def citation_recovered(spark: SparkSession, base: str) -> DataFrame:
    """Citations of the model channel traced to a unique span of the pattern channel."""
    rows = _plain(spark, base)
    return extraction.recovered(rows.where("extraction_method = 'llm'").drop("start", "end"), rows.where("extraction_method = 'regex'").select("id", "number", "year", "start", "end"))


def redact(spark: SparkSession, base: str) -> DataFrame:
    """Errors on one line without keys."""
    rows = table(spark, base, "judge_votes", "error", "status").where("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n"))
    return rows.select("error", "n", text.redacted(F.col("error")).alias("shown"), usage.error_class(F.col("error")).alias("category"))


def text_words(spark: SparkSession, base: str) -> DataFrame:
    """Characters and words of every question, and whether its length suits."""
    n = text.word_count(F.col("query"))
    return table(spark, base, "benchmark_tasks", "task_id", "query").select("task_id", F.length("query").alias("chars"), n.alias("words"), (F.length("query") >= 15).alias("long_enough"), (n <= 150).alias("short_enough"))


def text_area_key(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "benchmark_tasks", "macro_area").unionByName(table(spark, base, "provvedimenti", "macro_area")).groupBy("macro_area").agg(F.count("*").alias("n"))
    return rows.select("macro_area", "n", text.area_key(F.col("macro_area")).alias("key"), text.area(F.col("macro_area")).alias("area"))


def text_ascii_words(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "criterion_results", "title").distinct().select("title", text.ascii_words(F.col("title")).alias("words"), text.slug(F.col("title"), lower=True).alias("slug"))


def percents(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "task_scores").groupBy("model").agg(F.round(F.avg("required_pass_rate"), 6).alias("rate"), F.avg(F.lit(None).cast("double")).alias("none"))
    return rows.select("model", "rate", text.percent(F.col("rate")).alias("plain"), text.percent(F.col("rate"), comma=True).alias("comma"), text.percent(F.col("none"), comma=True).alias("missing"))


def tristates(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "task_scores").select(F.col("all_pass").cast("string").alias("raw")).unionByName(table(spark, base, "judge_votes").select(F.col("verdict").alias("raw")))
    return rows.groupBy("raw").agg(F.count("*").alias("n")).select("raw", "n", text.tristate(F.col("raw")).alias("parsed"), text.count_value(F.col("raw")).alias("number"))


# ---- matching and sampling ---------------------------------------------------------------


def question_duplicates(spark: SparkSession, base: str) -> DataFrame:
    """Questions and answers filed more than once, by their key."""
    texts = table(spark, base, "benchmark_tasks").select(F.lit("question").alias("kind"), "query").unionByName(table(spark, base, "task_scores").select(F.lit("answer").alias("kind"), F.col("model_output").alias("query")))
    return texts.groupBy("kind", F.md5(text.question_key(F.col("query"))).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def question_match(spark: SparkSession, base: str) -> DataFrame:
    """Answers whose text, as a sheet would have it, is a task's question."""
    tasks = table(spark, base, "benchmark_tasks").select(F.col("task_id").alias("a"), "query")
    answers = table(spark, base, "task_scores").select(F.col("score_id").alias("b"), F.col("model_output").alias("query"))
    return matching.by_key(tasks, answers, text.sheet_key(F.col("query")), "a", "b", "query")


def missing_extra(spark: SparkSession, base: str) -> DataFrame:
    """Tasks of the set against tasks answered by one model."""
    given = table(spark, base, "task_scores", "task_id", "model").where("model = 'falena-8b'").select("task_id")
    return matching.missing_and_extra(table(spark, base, "benchmark_tasks").where("task_type = 'standard'").select("task_id"), given, "task_id")


def answers_last(spark: SparkSession, base: str) -> DataFrame:
    """Of several answers to a question the last one."""
    return matching.last_wins(table(spark, base, "task_scores", "task_id", "score_id"), "task_id", "score_id", "score_id")


def answer_problems(spark: SparkSession, base: str) -> DataFrame:
    joined = table(spark, base, "task_scores", "score_id", "task_id", "model_output").join(table(spark, base, "benchmark_tasks", "task_id", "query"), "task_id", "left")
    return matching.row_problems(joined, "query", "model_output").select("score_id", "problem")


def outputs_joined(spark: SparkSession, base: str) -> DataFrame:
    """Every task with its number of answers, none included."""
    answers = table(spark, base, "task_scores", "task_id", "score_id", "model_output")
    joined = table(spark, base, "benchmark_tasks", "task_id").join(answers, "task_id", "left")
    return joined.groupBy("task_id").agg(F.count("score_id").alias("answers"), F.count_if(F.length(F.trim(F.coalesce("model_output", F.lit("")))) > 0).alias("filled"))


def sample_tasks(spark: SparkSession, base: str) -> DataFrame:
    """Twenty tasks by seed; the sample is the feature."""
    return matching.sampled(table(spark, base, "benchmark_tasks", "task_id"), "task_id", 20, 42)


def sample_by_area(spark: SparkSession, base: str) -> DataFrame:
    """Three tasks of each area by seed."""
    return matching.sampled_by(table(spark, base, "benchmark_tasks", "task_id", "macro_area").withColumn("area", text.area(F.col("macro_area"))), "area", "task_id", 3, 7).select("task_id", "area")


def criteria_rows(spark: SparkSession, base: str) -> DataFrame:
    """Criteria of every task, one row each, defaults filled."""
    rows = table(spark, base, "benchmark_tasks", "task_id", "criteria").select("task_id", F.posexplode("criteria").alias("place", "c"))
    return rows.select("task_id", "place", "c.id", "c.title", F.size("c.deliverables").alias("deliverables"), F.coalesce("c.scoring_type", F.lit("required")).alias("scoring_type"), F.coalesce("c.category", F.lit("legal")).alias("category"))


def first_principles(spark: SparkSession, base: str) -> DataFrame:
    """At most five principles of each ruling, as a prompt shows them; the limit is the prompt's."""
    return table(spark, base, "provvedimenti", "prov_id", "principles").select("prov_id", F.array_join(F.slice(F.coalesce("principles", F.array().cast("array<string>")), 1, 5), "\n").alias("shown"), F.coalesce(F.size("principles"), F.lit(0)).alias("all"))


# ---- model calls -------------------------------------------------------------------------


def _calls(spark: SparkSession, base: str) -> DataFrame:
    pick = {"latency_ms": "model_call_latency_ms", "input_tokens": "model_call_input_tokens", "output_tokens": "model_call_output_tokens", "cost_usd": "model_call_estimated_cost_usd", "provider": "model_call_provider", "model": "model"}
    return table(spark, base, "task_scores").select(*[F.col(v).alias(k) for k, v in pick.items()])


def model_call_summary(spark: SparkSession, base: str) -> DataFrame:
    return usage.totals(_calls(spark, base))


def model_calls_by_model(spark: SparkSession, base: str) -> DataFrame:
    return usage.totals(_calls(spark, base), "model", "provider")


def judge_latency(spark: SparkSession, base: str) -> DataFrame:
    calls = table(spark, base, "judge_votes").select("model", "provider", "latency_ms", "attempts", "status")
    return calls.groupBy("model", "provider", "status").agg(F.count("*").alias("calls"), F.sum("attempts").alias("attempts"), F.round(F.avg("latency_ms"), 4).alias("mean_ms"), F.max("latency_ms").alias("max_ms"))


QUERIES = {f.__name__: f for f in (
    ecli_normalise, ecli_fields, namespace_infer, number_normalise, code_normalise, ecli_build, authority_codes, extract_identifiers, extract_numbers, extract_references, extract_channels, extract_merged, fast_path, extraction_check,
    citation_merge, citation_keys, citation_links, citation_recovered, redact, text_words, text_area_key, text_ascii_words, percents, tristates, question_duplicates, question_match, missing_extra, answers_last, answer_problems,
    outputs_joined, sample_tasks, sample_by_area, criteria_rows, first_principles, model_call_summary, model_calls_by_model, judge_latency,
)}

WS = "E' \\t\\n\\r'"
_num = lambda c: f"(CASE WHEN regexp_full_match(trim({c}, {WS}), '[0-9]+') THEN coalesce(nullif(ltrim(trim({c}, {WS}), '0'), ''), '0') END)"
_SPACE = r"[\s\x{A0}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_key = lambda e, n: f"coalesce({_CANON.format(e)}, CASE WHEN {_num(n)} IS NOT NULL AND year IS NOT NULL THEN concat_ws('|', coalesce(suggested_namespace, ''), CAST(year AS VARCHAR), {_num(n)}, coalesce(legal_area, '')) END, lower(trim(text)))"
_ns = lambda it: f"(CASE WHEN {it} THEN CASE WHEN split_part(k, ':', 3) IN ('CASS', 'COST', 'CONT', 'ABF', 'COVIP') THEN split_part(k, ':', 3) WHEN split_part(k, ':', 3) = 'CDS' OR starts_with(split_part(k, ':', 3), 'TAR') THEN 'ADM' WHEN split_part(k, ':', 3)[:3] IN ('CG1', 'CG2') THEN 'TAX' WHEN split_part(k, ':', 3)[:2] IN ('CA', 'TR') THEN 'MER' END END)"
_kind = "(CASE rtrim(upper(trim(doc_type)), '.') WHEN 'SENTENZA' THEN 'SENT' WHEN 'SENT' THEN 'SENT' WHEN 'ORDINANZA' THEN 'ORD' WHEN 'ORD' THEN 'ORD' WHEN 'DECRETO' THEN 'DEC' WHEN 'DEC' THEN 'DEC' END)"
_up = "trim(upper(regexp_replace(strip_accents({0}), '[^A-Za-z0-9]+', ' ', 'g')))"
_code = "nullif(regexp_replace(upper(trim(court)), '[^A-Z0-9]', '', 'g'), '')"
_qkey = f"trim(regexp_replace(replace(lower(query), 'ß', 'ss'), '{_SPACE}+', ' ', 'g'))"
_skey = f"replace(trim(regexp_replace(lower(translate(replace(query, '…', '...'), '" + "".join(text.TYPOGRAPHIC).replace("'", "''") + "', '" + "".join(text.TYPOGRAPHIC.values()).replace("'", "''") + f"')), '{_SPACE}+', ' ', 'g')), 'ß', 'ss')"
_ROWS = f"(SELECT DISTINCT citation_id, score_id AS id, extraction_method AS m, {_CANON.format('ecli')} AS ecli, suggested_namespace AS ns, {_num('number')} AS number, year, legal_area AS area, span_start AS s, span_end AS e FROM citations)"
_TOTALS = "count(*) AS calls, count(latency_ms) AS timed, CAST(coalesce(sum(latency_ms), 0) AS BIGINT) AS latency_total_ms, round(avg(latency_ms), 4) AS latency_mean_ms, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, round(sum(cost_usd), 6) AS cost_usd"
_CALLS = "(SELECT model, model_call_provider AS provider, model_call_latency_ms AS latency_ms, model_call_input_tokens AS input_tokens, model_call_output_tokens AS output_tokens, model_call_estimated_cost_usd AS cost_usd FROM task_scores)"
_first = lambda f, g: f"(array_agg({f} ORDER BY span_start, span_end, citation_id) FILTER ({f} IS NOT NULL))[1] AS {g}"


_lit = lambda p: "'" + p.replace("'", "''") + "'"


def _masked(column: str) -> str:
    for pattern in extraction.COVERED:
        column = f"regexp_replace({column}, {_lit(pattern)}, ' ', 'g')"
    return column


def _area(column: str) -> str:
    from giurispark.plans.corpus import area_sql

    return area_sql(column)


_akey = "trim(regexp_replace(replace(replace(lower(strip_accents(trim(coalesce(macro_area, ''), " + WS + "))), 'ß', 'ss'), '&', ' e '), '[^a-z0-9]+', '_', 'g'), '_')"
ORACLE = {
    "ecli_normalise": f"SELECT DISTINCT ecli, {_CANON.format('ecli')} AS canonical FROM citations",
    "ecli_fields": f"SELECT ecli, CAST(split_part(ecli, ':', 4) AS INT) AS year, nullif(regexp_extract(split_part(ecli, ':', 5), '^0*([0-9]+)', 1), '') AS number, nullif(regexp_extract(ecli, '(CIV|PEN)$', 1), '') AS area, split_part(ecli, ':', 3) AS court FROM (SELECT DISTINCT {_CANON.format('ecli')} AS ecli FROM registry)",
    "namespace_infer": f"SELECT k AS canonical, suggested_namespace, {_ns("split_part(k, ':', 2) = 'IT'")} AS inferred, {_ns('k IS NOT NULL')} AS inferred_any, coalesce({_ns("split_part(k, ':', 2) = 'IT'")}, CASE WHEN upper(trim(suggested_namespace)) IN ('CASS', 'MER', 'ADM', 'COST', 'CONT', 'TAX', 'ABF', 'COVIP') THEN upper(trim(suggested_namespace)) END) AS namespace FROM (SELECT DISTINCT {_CANON.format('ecli')} AS k, suggested_namespace FROM citations)",
    "number_normalise": f"SELECT DISTINCT number, year, {_num('number')} AS plain, CASE WHEN length({_num('number')}) >= 8 THEN {_num('number')} ELSE lpad({_num('number')}, 8, '0') END AS padded, CASE WHEN year BETWEEN 1000 AND 9999 THEN year END AS good_year FROM citations",
    "code_normalise": f"SELECT DISTINCT doc_type, legal_area, court, sector, {_kind} AS kind, CASE rtrim(upper(trim(legal_area)), '.') WHEN 'CIV' THEN 'CIV' WHEN 'CIVILE' THEN 'CIV' WHEN 'PEN' THEN 'PEN' WHEN 'PENALE' THEN 'PEN' END AS area, {_code} AS code, CASE WHEN {_up.format('sector')} IN ('SU', 'S U', 'SEZ UN') THEN 'SU' WHEN {_up.format('sector')} IN ('L', 'LAV', 'LAVORO') THEN 'L' END AS plenary, nullif(regexp_replace({_up.format('sector')}, '^(SEZ|SEZIONE) ', ''), '') AS division FROM registry",
    "ecli_build": f"""SELECT DISTINCT namespace, court, year, number, legal_area, doc_type, CASE upper(namespace) WHEN 'CASS' THEN 'ECLI:IT:CASS:' || year || ':' || number || legal_area WHEN 'COST' THEN 'ECLI:IT:COST:' || year || ':' || number WHEN 'ABF' THEN 'ECLI:IT:ABF:' || year || ':' || number WHEN 'ADM' THEN 'ECLI:IT:' || {_code} || ':' || year || ':' || number || {_kind} END AS built,
CASE upper(namespace) WHEN 'CASS' THEN 'ECLI:IT:CASS:' || year || ':' || number WHEN 'CONT' THEN 'ECLI:IT:CONT:' || year || ':' || number WHEN 'MER' THEN 'ECLI:IT:' || {_code} || ':' || year || ':' || number || '.' WHEN 'ADM' THEN CASE WHEN {_kind} IS NULL THEN 'ECLI:IT:' || {_code} || ':' || year || ':' || number END END AS start FROM registry""",
    "extract_identifiers": "SELECT score_id AS id, upper(e) AS ecli, count(*) AS mentions FROM (SELECT score_id, unnest(regexp_extract_all(model_output, '(?i)\\b(ECLI:IT:[A-Z0-9]+:[0-9]{4}:[A-Z0-9.]*[A-Z0-9])\\b', 1)) AS e FROM task_scores) GROUP BY ALL",
    "extract_numbers": r"SELECT regexp_replace(p, '\s*(/|\s+del\s+)\s*', '/') AS pair, count(*) AS mentions, count(DISTINCT score_id) AS answers FROM (SELECT score_id, unnest(regexp_extract_all(model_output, '(?i)(?:n\.|num\.|numero)\s*([0-9]+\s*(?:/|\s+del\s+)\s*[0-9]{4})', 1)) AS p FROM task_scores) GROUP BY ALL",
    "fast_path": "SELECT score_id AS id FROM (SELECT score_id, model_output AS t, " + _masked("model_output") + " AS rest FROM task_scores) WHERE (" + " OR ".join(f"regexp_matches(t, {_lit(p)})" for p in extraction.COVERED) + f") AND NOT regexp_matches(rest, {_lit(extraction.LOOSE)})",
    "extraction_check": "SELECT extraction_method, count(*) AS n, count(*) FILTER (contains(model_output, text)) AS verbatim, count(*) FILTER (substring(model_output, span_start + 1, span_end - span_start) = text) AS at_span FROM (SELECT DISTINCT citation_id, score_id, text, span_start, span_end, extraction_method FROM citations) JOIN task_scores USING (score_id) GROUP BY ALL",
    "citation_merge": f"WITH r AS (SELECT * REPLACE ({_CANON.format('ecli')} AS ecli), {_key('ecli', 'number')} AS key FROM citations) SELECT score_id, key, " + ", ".join(_first(f, f) for f in _MERGE) + ", CASE WHEN count(DISTINCT extraction_method) > 1 THEN 'merged' ELSE min(extraction_method) END AS extraction_method, CAST(count(*) AS INT) AS mentions FROM r GROUP BY ALL",
    "citation_keys": f"SELECT DISTINCT ecli, suggested_namespace, number, year, legal_area, text, {_key('ecli', 'number')} AS key FROM citations",
    "citation_links": f"SELECT p.citation_id, arg_min(u.ecli, {{'s': u.s, 'e': u.ecli}}) AS linked_ecli FROM {_ROWS} p JOIN {_ROWS} u ON p.id = u.id AND p.year = u.year AND p.number = u.number AND (p.area IS NULL OR u.area IS NULL OR p.area = u.area) WHERE p.ecli IS NULL AND p.ns = 'CASS' AND u.ecli IS NOT NULL GROUP BY 1",
    "citation_recovered": f"SELECT l.citation_id, count(DISTINCT {{'s': r.s, 'e': r.e}}) AS spans, CASE WHEN count(DISTINCT {{'s': r.s, 'e': r.e}}) = 1 THEN min(r.s) END AS start, CASE WHEN count(DISTINCT {{'s': r.s, 'e': r.e}}) = 1 THEN min(r.e) END AS \"end\" FROM {_ROWS} l JOIN {_ROWS} r ON l.id = r.id AND l.number = r.number AND l.year = r.year WHERE l.m = 'llm' AND r.m = 'regex' GROUP BY 1",
    "text_words": f"SELECT task_id, length(query) AS chars, CAST(CASE WHEN trim(regexp_replace(query, '{_SPACE}+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(query, '{_SPACE}+', ' ', 'g')), ' ')) END AS INT) AS words, length(query) >= 15 AS long_enough, CASE WHEN trim(regexp_replace(query, '{_SPACE}+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(query, '{_SPACE}+', ' ', 'g')), ' ')) END <= 150 AS short_enough FROM benchmark_tasks",
    "text_area_key": f"SELECT macro_area, count(*) AS n, {_akey} AS key, {_area('macro_area')} AS area FROM (SELECT macro_area FROM benchmark_tasks UNION ALL SELECT macro_area FROM provvedimenti) GROUP BY macro_area",
    "text_ascii_words": f"SELECT DISTINCT title, {_up.format('title')} AS words, lower(regexp_replace(translate(title, '/:', '--'), '[^A-Za-z0-9._-]+', '-', 'g')) AS slug FROM criterion_results",
    "percents": "SELECT model, rate, format('{:.1f}%', rate * 100) AS plain, replace(format('{:.1f}%', rate * 100), '.', ',') AS comma, 'n.d.' AS missing FROM (SELECT model, round(avg(required_pass_rate), 6) AS rate FROM task_scores GROUP BY 1)",
    "tristates": f"SELECT raw, count(*) AS n, CASE WHEN lower(trim(raw, {WS})) IN ('true', '1', 'yes', 'y') THEN true WHEN lower(trim(raw, {WS})) IN ('false', '0', 'no', 'n') THEN false END AS parsed, coalesce(TRY_CAST(raw AS INT), 0) AS number FROM (SELECT CAST(all_pass AS VARCHAR) AS raw FROM task_scores UNION ALL SELECT verdict FROM judge_votes) GROUP BY raw",
    "question_duplicates": f"SELECT kind, md5({_qkey}) AS key, count(*) AS n FROM (SELECT 'question' AS kind, query FROM benchmark_tasks UNION ALL SELECT 'answer', model_output FROM task_scores) GROUP BY ALL HAVING count(*) > 1",
    "question_match": f"SELECT a.task_id AS a, b.score_id AS b FROM (SELECT task_id, {_skey} AS k FROM benchmark_tasks) a JOIN (SELECT score_id, {_skey.replace('query', 'model_output')} AS k FROM task_scores) b USING (k)",
    "missing_extra": "WITH e AS (SELECT DISTINCT task_id FROM benchmark_tasks WHERE task_type = 'standard'), g AS (SELECT task_id FROM task_scores WHERE model = 'falena-8b') SELECT task_id, 'missing' AS problem FROM e WHERE task_id NOT IN (SELECT task_id FROM g) UNION ALL SELECT DISTINCT task_id, 'extra' FROM g WHERE task_id NOT IN (SELECT task_id FROM e) UNION ALL SELECT task_id, 'duplicate' FROM g GROUP BY task_id HAVING count(*) > 1",
    "answers_last": "SELECT task_id, max(score_id) AS score_id FROM task_scores GROUP BY 1",
    "answer_problems": f"WITH j AS (SELECT score_id, coalesce(regexp_replace(query, '{_SPACE}', '', 'g'), '') = '' AS q, coalesce(regexp_replace(model_output, '{_SPACE}', '', 'g'), '') = '' AS a FROM task_scores LEFT JOIN benchmark_tasks USING (task_id)) SELECT score_id, CASE WHEN q AND a THEN 'blank' WHEN q THEN 'no question' ELSE 'no answer' END AS problem FROM j WHERE q OR a",
    "outputs_joined": "SELECT task_id, count(score_id) AS answers, count(*) FILTER (length(trim(coalesce(model_output, ''))) > 0) AS filled FROM benchmark_tasks LEFT JOIN task_scores USING (task_id) GROUP BY 1",
    "sample_tasks": "SELECT task_id FROM benchmark_tasks ORDER BY md5('42/' || task_id), task_id LIMIT 20",
    "sample_by_area": f"SELECT task_id, area FROM (SELECT task_id, {_area('macro_area')} AS area FROM benchmark_tasks) QUALIFY row_number() OVER (PARTITION BY area ORDER BY md5('7/' || task_id), task_id) <= 3",
    "criteria_rows": "SELECT task_id, CAST(i - 1 AS INT) AS place, criteria[i].id AS id, criteria[i].title AS title, CAST(len(criteria[i].deliverables) AS INT) AS deliverables, coalesce(criteria[i].scoring_type, 'required') AS scoring_type, coalesce(criteria[i].category, 'legal') AS category FROM (SELECT task_id, criteria, unnest(range(1, len(criteria) + 1)) AS i FROM benchmark_tasks)",
    "first_principles": "SELECT prov_id, coalesce(array_to_string(principles[1:5], chr(10)), '') AS shown, CAST(coalesce(len(principles), 0) AS INT) AS \"all\" FROM provvedimenti",
    "model_call_summary": f"SELECT {_TOTALS} FROM {_CALLS}",
    "model_calls_by_model": f"SELECT model, provider, {_TOTALS} FROM {_CALLS} GROUP BY model, provider",
    "judge_latency": "SELECT model, provider, status, count(*) AS calls, CAST(sum(attempts) AS BIGINT) AS attempts, round(avg(latency_ms), 4) AS mean_ms, max(latency_ms) AS max_ms FROM judge_votes GROUP BY ALL",
}
