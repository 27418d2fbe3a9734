"""Resolution of citations against the registry, and their grounding in a question's profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from giurispark.functions import ecli
from giurispark.functions.text import ascii_words
from giurispark.session import cut

#: Statuses a report counts, and relations of a citation to a profile.
STATUSES = (
    "resolved_local_registry_exact", "resolved_local_registry_incomplete", "resolved_local_registry_metadata_mismatch", "ambiguous_local_registry",
    "not_found_in_index", "outside_index_scope", "resolver_error", "citation_extraction_error", "confirmed_fabricated", "insufficient_data",
)
RELATIONS = ("issue_aligned", "retrieved_only", "outside_profile", "unresolved", "fabricated_or_not_found")
#: Identifiers looked at for a prefix, and rows of a year from which on it counts as covered.
PREFIX_CAP, COVERED_ROWS = 25, 1000
MERIT_COURT = r"(?i)\b(Trib\.|Tribunale|App\.|Corte d['’]appello|Corte di appello)"


def sector(value: Column) -> Column:
    """SU or L for a section of the Cassation named in any of the usual ways."""
    plenary = r"^(CASS ?)?S ?U$|^S ?S ?U ?U$|^SEZ ?UN(ITE)?$|SEZIONI ?UNITE|SEZ UNITE|SS UU|\bCASS ?SU\b"
    labour = r"^L(AV(ORO)?)?$|^SEZ ?L(AV(ORO)?)?$|SEZ LAV|\bSEZ L\b|\bCASS ?LAV\b"
    return ecli.let(ascii_words(value), lambda words: F.when(words.rlike(plenary), "SU").when(words.rlike(labour), "L"))


def division(value: Column) -> Column:
    return ecli.nonempty(F.regexp_replace(ascii_words(value), "^(SEZ|SEZIONE) ", ""))


def current_registry(registry: DataFrame) -> DataFrame:
    """One row per canonical ECLI: the latest load, if it was not withdrawn; norm_* are the forms citations compare with."""
    rows = registry.withColumn("ecli", ecli.canonical(F.col("ecli"))).where("ecli IS NOT NULL")
    fields = ["namespace", "court", "year", "number", "legal_area", "doc_type", "sector", "publication_date", "deleted_at"]
    # normalised before the aggregate, so that later stages meet plain columns
    norms = {"norm_area": ecli.legal_area(F.col("legal_area")), "norm_type": ecli.doc_type(F.col("doc_type")), "norm_sector": sector(F.col("sector"))}
    last = rows.groupBy("ecli").agg(F.max(F.struct("loaded_at", *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields], *[v.alias(k) for k, v in norms.items()])).alias("r"))
    back = {f: F.nullif(F.col(f"r.{f}"), F.lit("")) for f in fields}
    return last.where("r.deleted_at = ''").select(
        "ecli", *[back[f].cast("int").alias(f) if f == "year" else back[f].cast("long").alias(f) if f == "number" else back[f].alias(f) for f in fields if f != "deleted_at"], "r.norm_area", "r.norm_type", "r.norm_sector"
    )


def components(citations: DataFrame) -> DataFrame:
    """Citations with normalised fields, one row per citation_id: of rows that differ the greatest one, whole."""
    raw = ["score_id", "task_id", "text", "ecli", "suggested_namespace", "number", "year", "legal_area", "section", "doc_type", "outside_index_scope"]
    one = citations.groupBy("citation_id").agg(F.max(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in raw])).alias("r"))
    r = {c: ecli.nonempty(F.col(f"r.{c}")) for c in raw}
    one = one.select("citation_id", r["score_id"].cast("long").alias("score_id"), r["task_id"].alias("task_id"), r["text"].alias("text"), F.coalesce(r["outside_index_scope"].cast("boolean"), F.lit(False)).alias("outside"),
                     ecli.canonical(r["ecli"]).alias("ecli"), F.upper(ecli.strip(r["suggested_namespace"])).alias("suggested"), ecli.year(r["year"]).alias("year"), ecli.number(r["number"]).alias("number"),
                     ecli.legal_area(r["legal_area"]).alias("legal_area"), ecli.doc_type(r["doc_type"]).alias("doc_type"), division(r["section"]).alias("division"), sector(r["section"]).alias("section_sector"))
    space = ecli.namespace_for(F.col("ecli"), F.col("suggested"))
    return one.withColumn("namespace", space).select(
        "citation_id", "score_id", "task_id", "text", "outside", "ecli", "namespace", "year", "number", "legal_area", "doc_type", "division", F.when(F.col("namespace") == "CASS", F.col("section_sector")).alias("sector")
    )


def diagnostics(mine: dict[str, Column], theirs: dict[str, Column]) -> tuple[Column, Column]:
    """(mismatched fields, incomplete fields) as arrays, of a citation against a registry row.

    A field the registry lacks is incomplete. Two fields speak for another: a plenary ruling is of no other division, and
    the labour section has no criminal rulings.
    """
    area, kind, sect = theirs["area"], theirs["type"], theirs["sector"]
    differs = lambda a, b: a.isNotNull() & b.isNotNull() & (a != b)
    lacks = lambda a, b: a.isNotNull() & b.isNull()
    plenary = mine["division"].isNotNull() & sect.eqNullSafe(F.lit("SU")) & (mine["division"] != "SU")
    criminal = (mine["sector"] == "L") & sect.isNull() & area.eqNullSafe(F.lit("PEN"))
    mismatch = F.array_compact(F.array(
        F.when(differs(mine["legal_area"], area), "legalArea"), F.when(differs(mine["doc_type"], kind), "docType"), F.when(differs(mine["sector"], sect) | criminal, "sector"), F.when(plenary, "division"),
    ))
    incomplete = F.array_compact(F.array(
        F.when(lacks(mine["legal_area"], area), "legalArea"), F.when(lacks(mine["doc_type"], kind), "docType"), F.when(lacks(mine["sector"], sect) & ~criminal, "sector"), F.when(mine["division"].isNotNull() & ~plenary, "division"),
    ))
    return mismatch, incomplete


def with_diagnostics(citations: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    reg = registry.select(F.col("ecli").alias("hit"), F.col("namespace").alias("hit_namespace"), F.col("norm_area").alias("r_area"), F.col("norm_type").alias("r_type"), F.col("norm_sector").alias("r_sector"))
    # merit courts: links part number and progressive by '-', the registry by '.'
    last = F.substring_index(F.col(key), ":", -1)
    indexed = F.when(last.contains("-"), F.concat(F.expr(f"left({key}, length({key}) - length(substring_index({key}, ':', -1)))"), F.expr(f"concat(substring_index(substring_index({key}, ':', -1), '-', 1), '.', substr(substring_index({key}, ':', -1), locate('-', substring_index({key}, ':', -1)) + 1))"))).otherwise(F.col(key))
    joined = citations.withColumn("_id", indexed).join(reg, (F.col("_id") == F.col("hit")) & (F.col("namespace") == F.col("hit_namespace")), "left").drop("_id")
    mismatch, incomplete = diagnostics({k: F.col(k) for k in ("legal_area", "doc_type", "division", "sector")}, {"area": F.col("r_area"), "type": F.col("r_type"), "sector": F.col("r_sector")})
    return joined.withColumns({"mismatch": mismatch, "incomplete": incomplete})


def _accuracy(mismatch: Column, incomplete: Column) -> Column:
    return F.when(F.size(mismatch) > 0, "metadata_mismatch").when(F.size(incomplete) > 0, "incomplete").otherwise("exact")


_OUT = ["citation_id", "score_id", "task_id", "text", "namespace", "ecli", "method", "status", "accuracy", "matched", "candidates", "requested"]


def _out(df: DataFrame) -> DataFrame:
    return df.select(*_OUT)


def exact(citations: DataFrame, registry: DataFrame) -> DataFrame:
    """Citations with an ECLI, explicit or built from complete metadata (column target)."""
    found = F.col("hit").isNotNull()
    return _out(with_diagnostics(citations, registry, "target").withColumns({
        "status": F.when(found, "resolved").otherwise("not_found"), "accuracy": F.when(found, _accuracy(F.col("mismatch"), F.col("incomplete"))).otherwise("unknown"),
        "matched": F.col("hit"), "candidates": found.cast("int"), "requested": F.array("target"),
    }))


def cassation(citations: DataFrame, registry: DataFrame) -> DataFrame:
    """Number and year alone: requested and homonymous candidates, decided by their count and coherence."""
    requested, other = ecli.cass_candidates(F.col("year"), F.col("number"), F.col("legal_area"))
    wide = citations.withColumns({"requested": requested, "homonyms": other})
    each = wide.withColumn("candidate", F.explode(F.concat(F.transform("requested", lambda x: F.struct(x.alias("id"), F.lit(True).alias("asked"))), F.transform("homonyms", lambda x: F.struct(x.alias("id"), F.lit(False).alias("asked"))))))
    joined = with_diagnostics(each.withColumns({"id": F.col("candidate.id"), "asked": F.col("candidate.asked")}), registry, "id")
    hit = F.col("hit").isNotNull() & F.col("asked")
    coherent, clean = hit & (F.size("mismatch") == 0), hit & (F.size("mismatch") == 0) & (F.size("incomplete") == 0)
    keys = ["citation_id", "score_id", "task_id", "text", "namespace", "ecli"]
    counted = joined.groupBy(*keys).agg(
        F.first("requested").alias("requested"), F.count_if(hit).alias("n"), F.count_if(clean).alias("n_clean"), F.count_if(coherent).alias("n_coherent"), F.count_if(F.col("hit").isNotNull() & ~F.col("asked")).alias("n_homonyms"),
        F.max(F.when(clean, F.col("hit"))).alias("clean"), F.max(F.when(coherent, F.col("hit"))).alias("coherent"), F.max(F.when(hit, F.col("hit"))).alias("any"), F.count_if(hit & (F.size("mismatch") > 0)).alias("n_mismatch"),
    )
    n, one = F.col("n"), F.col("n") == 1
    return _out(counted.withColumns({
        "method": F.lit("cass_exact_ecli_candidates"),
        "status": F.when(n == 0, "not_found").when((F.col("n_clean") == 1) | (F.col("n_coherent") == 1) | one, "resolved").otherwise("ambiguous"),
        "accuracy": F.when(n == 0, F.when(F.col("n_homonyms") > 0, "metadata_mismatch").otherwise("unknown")).when(F.col("n_clean") == 1, "exact").when(F.col("n_coherent") == 1, "incomplete")
        .when(F.col("n_mismatch") > 0, "metadata_mismatch").otherwise("incomplete"),
        "matched": F.when(F.col("n_clean") == 1, F.col("clean")).when(F.col("n_coherent") == 1, F.col("coherent")).when(one, F.col("any")),
        "candidates": F.when((F.col("n_clean") == 1) | (F.col("n_coherent") == 1), 1).otherwise(n).cast("int"),
    }))


def prefix_hits(citations: DataFrame, registry: DataFrame, cap: int = PREFIX_CAP) -> DataFrame:
    """The first registry ids that start with each citation's prefix.

    A prefix names court and year as whole parts and the start of the last one. Rulings of the courts and years asked for
    (a semi-join) give every start of their last part, so all of it is one equality join, and a court with many rulings in
    a year is spread by those starts. Citations of equal prefix share one lookup, and the cap applies before any other filter,
    first within each task.
    """
    wanted = citations.select("namespace", "prefix").distinct().withColumns({"court": ecli.part(F.col("prefix"), 2), "y": ecli.part(F.col("prefix"), 3), "start": ecli.part(F.col("prefix"), 4)})
    reg = registry.withColumns({"court_part": ecli.part(F.col("ecli"), 2), "year_part": ecli.part(F.col("ecli"), 3), "last": F.substring_index("ecli", ":", -1)}).withColumnsRenamed({"namespace": "r_namespace", "ecli": "hit", "court": "r_court", "year": "r_year", "number": "r_number", "norm_area": "r_area", "norm_type": "r_type"})
    asked = wanted.groupBy("namespace", "court", "y").agg(F.min(F.length("start")).alias("least"), F.max(F.length("start")).alias("most"))
    near = reg.join(asked, (F.col("r_namespace") == F.col("namespace")) & (F.col("court_part") == F.col("court")) & (F.col("year_part") == F.col("y"))).drop("namespace", "court", "y").where(F.length("last") >= F.col("least"))
    starts = near.withColumn("r_start", F.explode(F.transform(F.sequence("least", F.least("most", F.length("last"))), lambda n: F.expr("last").substr(F.lit(1), n)))).drop("least", "most", "last")
    on = (F.col("namespace") == F.col("r_namespace")) & (F.col("court") == F.col("court_part")) & (F.col("y") == F.col("year_part")) & (F.col("start") == F.col("r_start"))
    order = Window.partitionBy("namespace", "prefix").orderBy("hit")
    return wanted.join(starts, on).withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)


def by_prefix(citations: DataFrame, registry: DataFrame) -> DataFrame:
    """Incomplete metadata: the capped hits that agree in every known field; one is a match, several are ambiguous."""
    hits = prefix_hits(citations, registry).select("namespace", "prefix", "hit", "r_court", "r_year", "r_number", "r_area", "r_type")
    fits = lambda mine, theirs: F.col(mine).isNull() | F.coalesce(F.col(mine) == theirs, F.lit(False))
    court = F.when(F.col("namespace").isin("CASS", "COST", "CONT", "ABF", "COVIP"), F.col("namespace"))
    ok = (
        (ecli.code(F.col("r_court")) == F.col("namespace")) & (court.isNull() | (ecli.code(F.col("r_court")) == court)) & fits("year", F.col("r_year")) & (F.col("number") == F.col("r_number").cast("string"))
        & fits("doc_type", F.col("r_type")) & fits("legal_area", F.col("r_area"))
    )
    joined = citations.join(hits, ["namespace", "prefix"], "left").groupBy(*[c for c in citations.columns]).agg(F.count_if(F.coalesce(ok, F.lit(False))).alias("n"), F.max(F.when(ok, F.col("hit"))).alias("hit"))
    return _out(joined.withColumns({
        "method": F.lit("prefix_metadata"), "status": F.when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "resolved").otherwise("ambiguous"),
        "accuracy": F.when(F.col("n") == 0, "unknown").when(F.col("n") == 1, "exact").otherwise("incomplete"), "matched": F.when(F.col("n") == 1, F.col("hit")), "candidates": F.col("n").cast("int"),
        "requested": F.array().cast("array<string>"),
    }))


def route(parts: DataFrame) -> DataFrame:
    """The branch each citation takes, with the ECLI or prefix it looks for."""
    none = F.lit(None).cast("string")
    own = F.when(F.col("namespace").isin("CASS", "COST", "CONT", "ABF", "COVIP"), F.col("namespace"))
    args = (F.col("namespace"), F.col("year"), F.col("number"), F.col("legal_area"), own, none, F.col("doc_type"), none)
    built, start = ecli.build_exact(*args), ecli.build_prefix(*args)
    known = F.col("year").isNotNull() & F.col("number").isNotNull()
    branch = (
        F.when(F.col("outside"), "outside").when(F.col("namespace").isNull(), "insufficient").when((F.col("namespace") == "COVIP") & F.col("ecli").isNull(), "insufficient")
        .when(F.col("ecli").isNotNull(), "exact_ecli").when(~known, "insufficient").when(F.col("namespace") == "CASS", "cassation")
        .when(built.isNotNull(), "constructed_ecli").when(start.isNotNull(), "prefix").otherwise("insufficient")
    )
    return parts.withColumns({"method": branch, "target": F.coalesce("ecli", built), "prefix": start})


def resolve(citations: DataFrame, registry: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """One row per citation: status, accuracy, matched ECLI, number of candidates, and the public final status.

    current: the registry as current_registry gives it, written once, where the caller has it already.
    """
    routed, reg = cut(route(components(citations))), current if current is not None else cut(current_registry(registry))  # five branches read them
    plain = lambda status, accuracy: {
        "status": F.lit(status), "accuracy": F.lit(accuracy), "matched": F.lit(None).cast("string"), "candidates": F.lit(0), "requested": F.array().cast("array<string>"),
    }
    parts = [
        _out(routed.where("method = 'outside'").withColumns(plain("outside_index_scope", "unknown"))),
        _out(routed.where("method = 'insufficient'").withColumns(plain("insufficient_data", "incomplete"))),
        exact(routed.where("method IN ('exact_ecli', 'constructed_ecli')"), reg),
        cassation(routed.where("method = 'cassation'"), reg),
        by_prefix(routed.where("method = 'prefix'"), reg),
    ]
    return finalised(reduce(DataFrame.unionByName, parts))


def finalised(resolved: DataFrame) -> DataFrame:
    status, accuracy = F.col("status"), F.col("accuracy")
    final = (
        F.when(status.isin("not_found", "insufficient_data"), "not_found_in_index").when(status == "ambiguous", "ambiguous_local_registry")
        .when(status == "resolved", F.concat(F.lit("resolved_local_registry_"), accuracy)).otherwise(status)
    )
    return resolved.withColumn("final_status", final)


def registry_coverage(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, cassation years): namespaces and courts present, and years with enough rows."""
    places = registry.select(F.explode(F.array("namespace", "court")).alias("place")).where("place IS NOT NULL").distinct()
    years = registry.where("namespace = 'CASS'").groupBy("year").agg(F.count("*").alias("n")).where(F.col("n") >= COVERED_ROWS).select("year")
    return places, years


def ground(resolved: DataFrame, profiles: DataFrame, places: DataFrame, years: DataFrame | None = None) -> DataFrame:
    """Relation of each citation to its task's profile (task_id, ecli, resolving), one row for each pair, and a note on coverage.

    A source that is not found counts as fabricated unless its court is not in the registry at all, or it is a court of
    merit cited without identifier. A Cassation year the registry covers poorly (not in years) is noted and counts all the
    same; where no year is covered, nothing is noted.
    """
    profile = profiles.groupBy("task_id", "ecli").agg(F.max("resolving").alias("resolving")).select(F.col("task_id").alias("p_task"), F.col("ecli").alias("p_ecli"), "resolving")
    joined = resolved.join(profile, (F.col("task_id") == F.col("p_task")) & (F.col("matched") == F.col("p_ecli")), "left")
    # of an explicit or built identifier the court decides; all requested ones of a citation share it
    named = F.coalesce(F.get("requested", F.lit(0)), F.col("ecli"))
    joined = joined.withColumns({"court_part": ecli.part(named, 2), "year_part": F.when(ecli.part(named, 2) == "CASS", ecli.year(ecli.part(named, 3)))})
    joined = joined.join(places.select(F.col("place").alias("court_part"), F.lit(True).alias("covered")), "court_part", "left")
    if years is None:
        joined = joined.withColumn("poor_year", F.lit(False))
    else:
        known = years.select(F.col("year").alias("year_part"), F.lit(True).alias("year_covered"))
        some = years.agg((F.count("*") > 0).alias("any_year"))  # one row
        joined = joined.join(known, "year_part", "left").crossJoin(F.broadcast(some)).withColumn("poor_year", F.col("any_year") & F.col("year_part").isNotNull() & F.col("year_covered").isNull())
    credit = F.col("final_status").isin("resolved_local_registry_exact", "resolved_local_registry_incomplete") & F.col("matched").isNotNull()
    absent, merit = F.col("court_part").isNotNull() & F.col("covered").isNull(), F.col("court_part").isNull() & F.coalesce(F.col("text").rlike(MERIT_COURT), F.lit(False))
    relation = (
        F.when(credit & F.col("resolving"), "issue_aligned").when(credit & F.col("p_ecli").isNotNull(), "retrieved_only").when(credit, "outside_profile")
        .when((F.col("final_status") == "not_found_in_index") & ~(absent | merit), "fabricated_or_not_found").otherwise("unresolved")
    )
    note = F.when(absent, "court_not_in_registry").when(F.col("poor_year"), "year_poorly_covered").when(merit, "merit_court_without_identifier")
    return joined.select(*resolved.columns, relation.alias("relation"), F.when(F.col("final_status") == "not_found_in_index", note).alias("note"))


def relation_counts(grounded: DataFrame, *keys: str) -> DataFrame:
    return grounded.groupBy(*keys).agg(F.count("*").alias("citations_total"), *[F.count_if(F.col("relation") == r).alias(r) for r in RELATIONS])


def grounding_summary(per_record: DataFrame, n_tasks: int | None = None) -> DataFrame:
    """Grounding and coverage over tasks: per_record has task_id, ordinal, citations_total, issue_aligned.

    A task answered several times counts with its last record in the means and with all records in the totals; the
    denominator is the number of tasks asked for, or of records reported.
    """
    last = per_record.groupBy("task_id").agg(F.max_by(F.struct("citations_total", "issue_aligned"), "ordinal").alias("x"), F.sum("citations_total").alias("t"), F.sum("issue_aligned").alias("a"), F.count("*").alias("records"))
    share = F.coalesce(F.try_divide(F.col("x.issue_aligned"), F.col("x.citations_total")), F.lit(0.0))
    sums = last.agg(F.sum(share).alias("g"), F.sum((F.col("x.issue_aligned") > 0).cast("int")).alias("c"), F.sum("records").alias("records"), F.sum("t").alias("citations_total"), F.sum("a").alias("issue_aligned"))
    n = F.lit(n_tasks) if n_tasks else F.col("records")
    return sums.select(
        F.round(F.coalesce(F.try_divide("g", n), F.lit(0.0)), 6).alias("gog"), F.round(F.coalesce(F.try_divide("c", n), F.lit(0.0)), 6).alias("coverage"),
        n.cast("long").alias("tasks_total"), F.col("records").alias("tasks_reported"), "citations_total", "issue_aligned",
    )
