"""Queries over the training-data operators, each over its whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from giurispark.llm import garble, leaks, neardup, packing, pairs, truncation, visual, votes
from giurispark.session import cut, spread
from giurispark.sources.tables import table

# ---- 1 and 6: answers ------------------------------------------------------------------


def _answers(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "task_scores").select(F.col("score_id").alias("id"), F.col("model").alias("grp"), F.col("task_id").alias("task"), F.col("model_output").alias("answer"))
    return spread(rows)  # asked of the scan; asked of a join it would run the join twice


def _questions(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "benchmark_tasks").select(F.col("task_id").alias("task"), F.col("query").alias("question"))


def _cuts(spark: SparkSession, base: str) -> DataFrame:
    """The unfinished answers, written once: they are few and read more than once."""
    return cut(truncation.truncated(table(spark, base, "task_scores", "score_id", "model", "model_output"), "score_id", "model_output", "model").where("cut is not null"))


def _unfinished(spark: SparkSession, base: str) -> DataFrame:
    return pairs.unfinished(_cuts(spark, base), _answers(spark, base), _questions(spark, base))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return _unfinished(spark, base).select(F.col("id").alias("score_id")).distinct()


def p1_models(spark: SparkSession, base: str) -> DataFrame:
    """Per model the share of its answers that is unfinished."""
    cut = _unfinished(spark, base).select(F.col("id").alias("score_id"), F.col("cut"))
    return (
        table(spark, base, "task_scores", "score_id", "model").join(cut, "score_id", "left").groupBy("model")
        .agg(F.count("*").alias("answers"), F.count("cut").alias("unfinished"), F.round(F.count("cut") / F.count("*"), 6).alias("share"),
             F.count_if(F.col("cut") == "word").alias("inside_word"), F.count_if(F.col("cut").isin("structure", "marker")).alias("inside_structure"))
    )


def _broken(spark: SparkSession, base: str) -> DataFrame:
    return pairs.broken(_answers(spark, base), _questions(spark, base), _cuts(spark, base).select("id"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return _broken(spark, base).select(F.col("id").alias("score_id"), "defect")


def p6_models(spark: SparkSession, base: str) -> DataFrame:
    """Defects per model."""
    return _broken(spark, base).groupBy(F.col("grp").alias("model"), "defect").agg(F.count("*").alias("answers"))


# ---- 4: one form of every text -----------------------------------------------------------

TEXTS = (("provvedimenti", "prov_id", "facts"), ("benchmark_tasks", "task_id", "query"))


def _forms(spark: SparkSession, base: str) -> DataFrame:
    return visual.consistent_forms(reduce(DataFrame.unionByName, (
        table(spark, base, name).select(F.lit(name).alias("src_table"), F.col(key).cast("string").alias("record_key"), F.col(text).alias("text")) for name, key, text in TEXTS
    )))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return _forms(spark, base).where("changed").select("src_table", "record_key")


def p4_forms(spark: SparkSession, base: str) -> DataFrame:
    """The one form of every question and every statement of facts."""
    return _forms(spark, base)


def p4_equal(spark: SparkSession, base: str) -> DataFrame:
    """Texts that compare equal in their one form, by a digest of it."""
    return (
        _forms(spark, base).groupBy("src_table", F.sha2("form", 256).alias("digest"))
        .agg(F.count("*").alias("records"), F.count_if("changed").alias("changed"), F.min("record_key").alias("first_key")).where("records > 1")
    )


# ---- 9: garbled text -----------------------------------------------------------------------


def _garbled(spark: SparkSession, base: str) -> DataFrame:
    return garble.garbled(table(spark, base, "documents", "doc_id", "text"), "doc_id", "text")


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return _garbled(spark, base).select(F.col("id").alias("doc_id"))


def p9_restored(spark: SparkSession, base: str) -> DataFrame:
    """The text of every affected document as far as it can be restored."""
    return _garbled(spark, base).select(F.col("id").alias("doc_id"), "restored", "spans", "swaps", "lost")


# ---- 2: judges -----------------------------------------------------------------------------

ITEM = ["score_id", "criterion_id"]


def _items(spark: SparkSession, base: str) -> DataFrame:
    return votes.by_item(votes.counting(table(spark, base, "judge_votes"), ITEM), ITEM)


def _consensus(spark: SparkSession, base: str) -> DataFrame:
    items = _items(spark, base)
    patterns = cut(votes.patterns(items))
    return votes.consensus(items, patterns, votes.reliability(patterns))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return _consensus(spark, base).where("n_pass > 0 AND n_fail > 0").select(*ITEM, "consensus")


def p2_items(spark: SparkSession, base: str) -> DataFrame:
    """Every item's consensus, the weighted leaning and its confidence, and its agreement."""
    return _consensus(spark, base).select(*ITEM, "n_pass", "n_fail", "consensus", "leaning", F.round("confidence", 6).alias("confidence"), F.round("agreement", 6).alias("agreement"))


def p2_judges(spark: SparkSession, base: str) -> DataFrame:
    """Reliability of each judge and judge model, beside their hits on the items settled by hand."""
    items = _items(spark, base)
    raters = votes.reliability(cut(votes.patterns(items)))
    gold = table(spark, base, "adjudications").groupBy(*ITEM).agg(F.max_by(F.lower(F.trim("gold_verdict")), "adjudicated_at").alias("gold"))
    hits = (
        items.join(gold, ITEM).select("gold", F.explode("votes").alias("v")).groupBy(F.col("v.judge").alias("judge"), F.col("v.model").alias("model"))
        .agg(F.count("*").alias("settled"), F.count_if(F.col("v.verdict") == F.col("gold")).alias("hits"))
    )
    return raters.join(hits, ["judge", "model"], "left").select(
        "judge", "model", "n_votes", F.col("compared").cast("long").alias("compared"), F.round("accuracy", 6).alias("accuracy"), F.round("weight", 6).alias("weight"),
        F.coalesce("settled", F.lit(0)).alias("settled"), F.round(F.try_divide("hits", "settled"), 6).alias("hit_rate"),
    )


def p2_agreement(spark: SparkSession, base: str) -> DataFrame:
    """Observed and chance-corrected agreement over all items."""
    return votes.alpha(votes.patterns(_items(spark, base)))


def p2_recorded(spark: SparkSession, base: str) -> DataFrame:
    """Recorded method and verdict against the derived consensus."""
    recorded = table(spark, base, "criterion_results", *ITEM, "consensus_method", F.col("verdict").alias("recorded"))
    return recorded.join(_consensus(spark, base).select(*ITEM, "consensus", "leaning"), ITEM, "left").groupBy("consensus_method", "recorded", "consensus", "leaning").agg(F.count("*").alias("items"))


# ---- 5: near copies ------------------------------------------------------------------------


def _records(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "provvedimenti").select(F.col("prov_id").alias("id"), F.concat_ws(" ", "facts", "principles").alias("text"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    records = _records(spark, base)
    features = neardup.features(records, sets=False)
    pairs_ = neardup.record_pairs(neardup.classes(features), neardup.class_pairs(features, texts=records))
    return pairs_.select(F.col("a").alias("prov_id_a"), F.col("b").alias("prov_id_b"))


def p5_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Pairs between the representatives of classes of equal texts."""
    records = _records(spark, base)
    found = neardup.class_pairs(neardup.features(records, sets=False), texts=records)
    return found.select(F.col("a").alias("prov_id_a"), F.col("b").alias("prov_id_b"), F.round("similarity", 6).alias("similarity"), "distance")


def p5_groups(spark: SparkSession, base: str) -> DataFrame:
    """Every ruling with the class of equal texts, its group of near copies and its number of links to other classes; one of fewer than three words is a class of its own."""
    records = _records(spark, base)
    features = neardup.features(records, sets=False)
    members, links = neardup.classes(features), neardup.class_pairs(features, texts=records)
    groups = neardup.components(members.where("id = rep").select("id"), links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    short = records.select(F.col("id").cast("long").alias("id")).join(features.select("id"), "id", "left_anti")
    return (
        members.join(groups.select(F.col("id").alias("rep"), "component"), "rep").join(degree, "rep", "left")
        .select(F.col("id").alias("prov_id"), F.col("rep").alias("class_id"), F.col("component").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
        .unionByName(short.select(F.col("id").alias("prov_id"), F.col("id").alias("class_id"), F.col("id").alias("group_id"), F.lit(0).alias("links")))
    )


# ---- 7: containers -------------------------------------------------------------------------


def p7_assignment(spark: SparkSession, base: str) -> DataFrame:
    """Container of every document, or of its pieces."""
    return packing.packed(table(spark, base, "documents", "doc_id", "text"))


def p7_fill(spark: SparkSession, base: str) -> DataFrame:
    """Containers, tokens and the share of unused space."""
    boxes = p7_assignment(spark, base).groupBy("container").agg(F.sum("tokens").alias("used"), F.countDistinct("doc_id").alias("docs"))
    return boxes.agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.round(1 - F.sum("used") / (F.count("*") * packing.CAPACITY), 6).alias("unused_share"), F.count_if(F.col("used") == packing.CAPACITY).alias("full"),
    )


# ---- 8: held-out passages ------------------------------------------------------------------


def _leaked(spark: SparkSession, base: str, near: bool) -> DataFrame:
    return leaks.leaked(table(spark, base, "documents", "doc_id", "text"), table(spark, base, "heldout_items", "item_id", "text"), near=near)


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return _leaked(spark, base, near=False).where("exact > 0").select("doc_id", "item_id")


def p8_items(spark: SparkSession, base: str) -> DataFrame:
    """How far each held-out item leaked."""
    return (
        table(spark, base, "heldout_items", "item_id", "kind").join(_leaked(spark, base, near=True), "item_id", "left").groupBy("item_id", "kind")
        .agg(F.count_if(F.col("exact") > 0).alias("documents"), F.count_if(F.col("exact") == 0).alias("near_only"), F.coalesce(F.max("exact"), F.lit(0)).alias("longest"))
    )


QUERIES = {f.__name__: f for f in (
    p1_found, p1_models, p2_found, p2_items, p2_judges, p2_agreement, p2_recorded, p4_found, p4_forms, p4_equal, p5_found, p5_pairs, p5_groups,
    p6_found, p6_models, p7_assignment, p7_fill, p8_found, p8_items, p9_found, p9_restored,
)}

_VOTES = """WITH valid AS (
  SELECT score_id, criterion_id, upper(trim(judge_id, E' \\t\\n\\r')) AS judge, model, lower(trim(verdict, E' \\t\\n\\r')) AS verdict, voted_at FROM judge_votes WHERE status = 'ok'),
latest AS (SELECT score_id, criterion_id, judge, arg_max(verdict, (voted_at, verdict, model)) AS verdict FROM valid WHERE verdict IN ('pass', 'fail') AND judge IS NOT NULL GROUP BY ALL),
items AS (SELECT score_id, criterion_id, count(*) FILTER (verdict = 'pass') AS p, count(*) FILTER (verdict = 'fail') AS f FROM latest GROUP BY ALL)
"""
ORACLE: dict[str, str] = {
    "p2_found": _VOTES + "SELECT score_id, criterion_id, CASE WHEN p >= 2 THEN 'pass' WHEN f >= 2 THEN 'fail' ELSE 'unresolved' END AS consensus FROM items WHERE p > 0 AND f > 0",
    "p2_agreement": _VOTES + """, s AS (SELECT count(*) AS items, sum(p) AS a, sum(f) AS b, sum(2.0 * p * f / (p + f - 1)) AS split, sum((p * (p - 1) + f * (f - 1)) / ((p + f) * (p + f - 1.0))) AS agree FROM items WHERE p + f >= 2)
SELECT items, CAST(a + b AS BIGINT) AS votes, round(agree / items, 6) AS observed, round(1 - (split / (a + b)) / (2.0 * a * b / ((a + b) * (a + b - 1))), 6) AS alpha FROM s""",
    # every 12-word window of every document against every one of the items
    "p8_found": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS w FROM documents), dw AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d),
h AS (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS w FROM heldout_items), hw AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM h)
SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS k FROM dw) JOIN (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS k FROM hw) USING (k)""",
    # all pairs over an inverted index of the word sequences of the consistent form
    "p5_found": f"""WITH src AS (SELECT 'p' AS src, prov_id AS id, concat_ws(' ', facts, array_to_string(principles, ' ')) AS text FROM provvedimenti), form AS ({visual.statement("src")}),
w AS (SELECT id, regexp_extract_all(strip_accents(lower(form)), '[\\p{{L}}\\p{{N}}]+') AS w FROM form), s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id), c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT a AS prov_id_a, b AS prov_id_b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k / (x.n + y.n - k) >= 0.6""",
}
