"""Readers for the files an evaluation leaves behind: corpora, tasks, scores, sheets, profiles, registries."""

from __future__ import annotations

import csv
import io
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from giurispark.functions import ecli, text

RULING = T.StructType([
    *[T.StructField(f, T.StringType()) for f in ("ecli_id", "macro_area", "division", "legal_area", "doc_type", "date", "facts")],
    T.StructField("principles", T.ArrayType(T.StringType())), T.StructField("decision", T.StringType()),
])
CRITERION = T.StructType([
    *[T.StructField(f, T.StringType()) for f in ("id", "title", "match_criteria")], T.StructField("deliverables", T.ArrayType(T.StringType())),
    T.StructField("scoring_type", T.StringType()), T.StructField("category", T.StringType()),
])
TASK = T.StructType([*[T.StructField(f, T.StringType()) for f in ("task_id", "task_type", "query", "macro_area", "source_ecli")], T.StructField("criteria", T.ArrayType(CRITERION))])
RESULT = T.StructType([*[T.StructField(f, T.StringType()) for f in ("id", "title", "verdict", "scoring_type", "category", "consensus_method")], T.StructField("supporting_judges", T.ArrayType(T.StringType())), T.StructField("tie_breaker_used", T.BooleanType())])
SCORE = T.StructType([
    *[T.StructField(f, T.StringType()) for f in ("task_id", "task_type", "macro_area", "model", "model_output", "response", "scoring_status", "verdict", "citation_verdict", "citation_scoring_status", "scored_at")],
    *[T.StructField(f, T.DoubleType()) for f in ("score", "citation_score")], T.StructField("all_pass", T.StringType()),
    *[T.StructField(f, T.StringType()) for f in ("n_criteria", "n_passed", "n_unresolved", "citations_extracted_count", "citations_fabricated_count")], T.StructField("criteria_results", T.ArrayType(RESULT)),
])


def decoded(content: Column) -> Column:
    """UTF-8 text of bytes, read as Latin-1 where they are no UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, content) of the JSON members of zip files; each archive is one task."""
    schema = pa.schema([("archive", pa.string()), ("path", pa.string()), ("content", pa.binary())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for name, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for member in z.namelist():  # a member at a time, so memory holds one payload
                        if member.endswith(".json") and not member.startswith("__MACOSX"):
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member]), pa.array([z.read(member)], pa.binary())], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(batches, "archive string, path string, content binary")


def rulings_from_zip(spark: SparkSession, path: str) -> DataFrame:
    """Rulings put together from their info and metadata members; 'problem' tells what is missing or unreadable."""
    members = zip_members(spark, path).select(F.regexp_extract("path", r"(ECLI_IT_[A-Z]+_\d+_[\w-]+)", 1).alias("ecli_id"), "path", decoded(F.col("content")).alias("json")).where("ecli_id <> ''")
    one = members.groupBy("ecli_id").agg(
        F.max_by("json", F.when(F.contains("path", F.lit("info")), F.col("path"))).alias("info"), F.max(F.when(F.contains("path", F.lit("info")), F.col("path"))).alias("info_path"),
        F.max_by("json", F.when(F.contains("path", F.lit("metadata")), F.col("path"))).alias("meta"), F.max(F.when(F.contains("path", F.lit("metadata")), F.col("path"))).alias("meta_path"),
    )
    info = F.from_json("info", "facts string, principles array<string>, decision string")
    meta = F.from_json("meta", "crMetadata struct<division string, legalArea string, docType string, publicationDate string>")
    problem = F.when(F.col("info_path").isNull() | F.col("meta_path").isNull(), "missing_file").when(F.try_parse_json("info").isNull() | F.try_parse_json("meta").isNull(), "bad_json")
    m = "m.crMetadata."
    return one.withColumns({"i": info, "m": meta, "problem": problem}).select(
        "ecli_id", F.coalesce(f"{m}division", F.lit("")).alias("division"), F.upper(F.trim(F.coalesce(f"{m}legalArea", F.lit("")))).alias("legal_area"), F.coalesce(f"{m}docType", F.lit("")).alias("doc_type"),
        F.coalesce(f"{m}publicationDate", F.lit("")).alias("date"), "i.facts", "i.principles", "i.decision", "problem",
    ).withColumn("macro_area", text.cassation_area(F.col("legal_area"), F.col("division")))


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines): blank lines are skipped, unreadable ones kept apart."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return lines.where("r._bad IS NULL").select("r.*").drop("_bad"), lines.where("r._bad IS NOT NULL").select(F.col("value").alias("_bad"))


def corpus(spark: SparkSession, path: str, area: str | None = None) -> DataFrame:
    rows = jsonl(spark, path, RULING)[0].where("ecli_id IS NOT NULL").withColumn("macro_area", text.area(F.col("macro_area")))
    return rows.where(F.col("macro_area") == text.area(F.lit(area), strict=True)) if area else rows


def tasks(spark: SparkSession, path: str, name: str = "task.json") -> DataFrame:
    """Task files below a folder; unreadable ones are left out, none at all is an error."""
    raw = spark.read.schema(T.StructType([*TASK.fields, T.StructField("_bad", T.StringType())])).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("columnNameOfCorruptRecord", "_bad").json(path)
    good = raw.withColumn("_path", F.col("_metadata.file_path")).where("_bad IS NULL AND task_id IS NOT NULL").drop("_bad").fillna({"source_ecli": ""})
    if not good.limit(1).count():
        raise FileNotFoundError(f"no task below {path}")
    return good


def gold(spark: SparkSession, path: str) -> DataFrame:
    """An array of false-premise tasks; any unreadable one is an error."""
    return spark.read.schema(T.StructType([*TASK.fields, T.StructField("difficulty", T.StringType())])).option("multiLine", True).option("mode", "FAILFAST").json(path)


def scores(spark: SparkSession, path: str, since: str | None = None, models: list[str] | None = None, name: str = "scores.json") -> DataFrame:
    """Score files below a folder with family, model and time of their run; charts and reviews are not entered."""
    root = re.escape(re.sub("^[a-z0-9]+:/+", "/", path.rstrip("/")) if "://" in path else Path(path).resolve().as_posix())
    raw = spark.read.schema(T.StructType([*SCORE.fields, T.StructField("_bad", T.StringType())])).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("columnNameOfCorruptRecord", "_bad").json(path)
    relative = F.regexp_replace(F.regexp_replace("_metadata.file_path", "^[a-z0-9]+:/+", "/"), f"^{root}/", "")
    rows = raw.select("*", relative.alias("path")).where("_bad IS NULL AND task_id IS NOT NULL").drop("_bad").where(~F.col("path").rlike("(^|/)(charts|reviews)/"))
    family, folder, stamp = text.path_parts(F.col("path"))
    rows = rows.withColumns({"family": family, "folder": folder, "run_timestamp": stamp})
    if since:
        rows = rows.where(F.col("run_timestamp") >= since)
    return rows.where(F.col("folder").isin(models)) if models else rows


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, answer, model) of scores.json, else outputs.json; blank answers are dropped."""
    folder = Path(path)
    file = folder if folder.is_file() else next((folder / n for n in ("scores.json", "outputs.json") if (folder / n).exists()), None)
    if file is None:
        raise FileNotFoundError(f"no answers in {path}")
    rows = spark.read.schema(SCORE).option("multiLine", True).json(str(file))
    answer = F.coalesce(ecli.nonempty(F.trim("response")), F.col("model_output"))
    return rows.select("task_id", answer.alias("answer"), "model").where(F.length(F.trim(F.coalesce("answer", F.lit("")))) > 0)


def outputs(spark: SparkSession, path: str, default: str = "unknown") -> tuple[str, DataFrame, DataFrame]:
    """(model, answers, ids) of a file of outputs: the model its first row names, or the default; answers that are not blank; all ids. An empty file is an error."""
    rows = spark.read.schema("task_id string, model string, response string").option("multiLine", True).json(path)
    first = rows.select("model").head()
    if first is None:
        raise ValueError(f"no outputs in {path}")
    named = rows.withColumn("task_id", F.trim("task_id")).where("task_id <> ''")
    answers_ = named.select("task_id", F.trim("response").alias("answer")).where("answer <> ''")
    return first["model"] or default, answers_, named.select("task_id")


def delimiter(spark: SparkSession, path: str) -> str:
    """Delimiter of a sheet by its first lines, wherever it lies; comma where it cannot be told."""
    head = "\n".join(r.value for r in spark.read.text(path).head(20)).lstrip("\ufeff")[:8192]
    try:
        return csv.Sniffer().sniff(head, delimiters=",;\t").delimiter
    except csv.Error:
        return ","


def sheet(spark: SparkSession, path: str, sep: str | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", sep or delimiter(spark, path)).csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if lacking := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns missing: {lacking}")
    return df


def first_column(columns: list[str], candidates: tuple[str, ...], explicit: str | None = None) -> str | None:
    """The column asked for, else the first candidate that occurs, case aside."""
    if explicit:
        if explicit not in columns:
            raise ValueError(f"no column {explicit}")
        return explicit
    by_name = {c.strip().lower(): c for c in columns}
    return next((by_name[c.lower()] for c in candidates if c.lower() in by_name), None)


def only_column(columns: list[str], candidates: tuple[str, ...]) -> str:
    """The one candidate that occurs; none or several is an error."""
    hits = [c for c in columns if c in candidates]
    if len(hits) != 1:
        raise ValueError(f"expected one of {candidates}, found {hits}")
    return hits[0]


def registry_from_sqlite(spark: SparkSession, path: str, out: str, batch: int = 100_000) -> tuple[DataFrame, dict[str, str]]:
    """Convert a registry file once to Parquet, sorted for lookups, and return it with its metadata."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        meta = dict(con.execute("SELECT key, value FROM meta"))
        cursor = con.execute("SELECT ecli, namespace, court, year, number, legal_area, variant, doc_type, sector, publication_date FROM registry ORDER BY namespace, ecli")
        schema = "ecli string, namespace string, court string, year int, number long, legal_area string, variant string, doc_type string, sector string, publication_date string"
        mode = "overwrite"
        while rows := cursor.fetchmany(batch):
            spark.createDataFrame(rows, schema).write.mode(mode).parquet(out)
            mode = "append"
        if mode == "overwrite":
            spark.createDataFrame([], schema).write.mode(mode).parquet(out)
    return spark.read.parquet(out), meta


PROFILE = "task_id string, macro_area string, question string, " + ", ".join(f"{f} array<struct<ecli string, evidence_tiers array<string>>>" for f in ("resolving_rulings", "retrieved_marginal", "retrieved_irrelevant", "retrieved_unassessed"))


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, ecli, resolving, tiers): the four lists of every profile in one table; the resolving ones are among the retrieved."""
    raw = spark.read.schema(PROFILE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path).where("task_id IS NOT NULL")
    parts = [raw.select("task_id", F.explode(f).alias("r"), F.lit(f == "resolving_rulings").alias("resolving")) for f in ("resolving_rulings", "retrieved_marginal", "retrieved_irrelevant", "retrieved_unassessed")]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.select("task_id", ecli.canonical(F.col("r.ecli")).alias("ecli"), "resolving", F.col("r.evidence_tiers").alias("tiers")).where("ecli IS NOT NULL")


def ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; blank lines and comments are left out."""
    return spark.read.text(path).select(F.trim(F.get(F.split("value", "#"), F.lit(0))).alias("id")).where("id <> ''")
