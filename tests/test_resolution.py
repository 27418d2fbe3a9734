import datetime as dt

from pyspark.sql import functions as F

from giurispark.operators import extraction, resolution
from giurispark.operators.ranking import numbered

REGISTRY = "ecli string, namespace string, court string, year int, number long, legal_area string, doc_type string, sector string, publication_date string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
CITATION = "citation_id long, score_id long, task_id string, text string, ecli string, suggested_namespace string, number string, year int, legal_area string, section string, doc_type string, outside_index_scope boolean"
T0 = dt.datetime(2024, 1, 1)


def registry(spark, *rows):
    return spark.createDataFrame([(e, ns, ns, y, n, a, k, s, None, T0, None) for e, ns, y, n, a, k, s in rows], REGISTRY)


HOMONYMS = (("ECLI:IT:CASS:2024:1234CIV", "CASS", 2024, 1234, "CIV", "SENTENZA", "1"), ("ECLI:IT:CASS:2024:1234PEN", "CASS", 2024, 1234, "PEN", None, None))


def resolve(spark, *citations):
    rows = [(i, 1, "t", "x", *c) for i, c in enumerate(citations)]
    got = resolution.resolve(spark.createDataFrame(rows, CITATION), registry(spark, *HOMONYMS))
    return {r.citation_id: r for r in got.collect()}


def test_explicit_identifier(spark):
    r = resolve(spark, ("ECLI:IT:CASS:2024:1234CIV", None, None, None, None, None, None, False))[0]
    assert (r.status, r.accuracy, r.final_status) == ("resolved", "exact", "resolved_local_registry_exact")


def test_homonyms_without_area_are_ambiguous_and_fail_closed(spark):
    r = resolve(spark, (None, "CASS", "1234", 2024, None, None, None, None))[0]
    assert (r.status, r.final_status, r.matched) == ("ambiguous", "ambiguous_local_registry", None)


def test_area_decides_and_kind_mismatch_costs_credit(spark):
    got = resolve(spark, (None, "CASS", "01234", 2024, "civile", None, None, None), (None, "CASS", "1234", 2024, "PEN", None, "sentenza", None), (None, "CASS", "1234", 2024, "CIV", None, "ord.", None), (None, "CASS", "9", 2024, "CIV", None, None, None), (None, None, "9", 2024, None, None, None, None), (None, "CASS", None, 2024, None, None, None, None), (None, "CASS", "1", 2024, None, None, None, True))
    assert [got[i].accuracy for i in range(7)] == ["exact", "incomplete", "metadata_mismatch", "unknown", "incomplete", "incomplete", "unknown"]
    assert [got[i].final_status for i in (3, 4, 5, 6)] == ["not_found_in_index"] * 3 + ["outside_index_scope"]


def test_relations(spark):
    citations = spark.createDataFrame([(1, 1, "t", "x", "ECLI:IT:CASS:2024:1234CIV", None, None, None, None, None, None, False), (2, 1, "t", "Trib. Roma 5/2020", None, "MER", "5", 2020, None, None, None, False), (3, 1, "t", "x", "ECLI:IT:CASS:2024:9CIV", None, None, None, None, None, None, False)], CITATION)
    reg = registry(spark, *HOMONYMS)
    places, years = resolution.registry_coverage(resolution.current_registry(reg))
    profile = spark.createDataFrame([("t", "ECLI:IT:CASS:2024:1234CIV", True)], "task_id string, ecli string, resolving boolean")
    got = {r.citation_id: r.relation for r in resolution.ground(resolution.resolve(citations, reg), profile, places).collect()}
    assert got == {1: "issue_aligned", 2: "unresolved", 3: "fabricated_or_not_found"}
    assert years.count() == 0


def test_grounding_summary(spark):
    one = spark.createDataFrame([("t", 1, 1, 1)], "task_id string, ordinal long, citations_total long, issue_aligned long")
    r = resolution.grounding_summary(one, 1).first()
    assert (r.gog, r.coverage) == (1.0, 1.0)
    assert resolution.grounding_summary(one, 67).first().gog == round(1 / 67, 6)
    twice = spark.createDataFrame([("t", 1, 2, 2), ("t", 2, 2, 0)], one.schema)
    r = resolution.grounding_summary(twice).first()
    assert (r.gog, r.citations_total, r.issue_aligned, r.tasks_total) == (0.0, 4, 2, 2)


def test_extraction_spans_links_and_short_forms():
    found = extraction.find("Cass. civ. sez. 1, sentenza n. 10 del 2020 e n. 5/2021; v. [x](https://a.example/ECLI_IT_CASS_2024_1234CIV). ECLI:IT:COST:2010:5. Vedi CEDU.")
    assert [(c["channel"], c.get("ecli"), c.get("number")) for c in found] == [("court", None, "10"), ("inherited", None, "5"), ("url", "ECLI:IT:CASS:2024:1234CIV", None), ("ecli", "ECLI:IT:COST:2010:5", None), ("outside", None, None)]
    assert found[1]["section"] == "1" and found[1]["authority"] == "Cass."


def test_numbers_within_groups(spark):
    rows = [("a" if i % 3 else "b", i) for i in range(200)]
    got = numbered(spark.createDataFrame(rows, "g string, v long"), ["g"], [F.col("v").asc()]).collect()
    for g in "ab":
        own = sorted(r.v for r in got if r.g == g)
        assert {r.v: r.position for r in got if r.g == g} == {v: i + 1 for i, v in enumerate(own)}


def court(text):
    return [(c["namespace"], c["authority"], c["number"], c["year"]) for c in extraction.find(text) if c["channel"] == "court"]


def test_long_names_and_sections():
    assert court("Tribunale di Santa Maria Capua Vetere sezione distaccata di Caserta n. 12/2020") == [("MER", "Tribunale di Santa Maria Capua Vetere sezione distaccata di Caserta", "12", 2020)]
    assert court("T. A. R. Lazio n. 3/2011; Cons. Stato, ord. n. 7 del 2013") == [("ADM", "T. A. R. Lazio", "3", 2011), ("ADM", "Cons. Stato", "7", 2013)]
    assert court("Corte cost., n. 5/1999 e Corte dei conti, n. 6/2001") == [("COST", "Corte cost.", "5", 1999), ("CONT", "Corte dei conti", "6", 2001)]
    assert court("Tribunale di Roma, la domanda, n. 4/2010") == [] and court("Cass. 12/2020") == []


def test_outside_sources_and_articles():
    found = [(c["namespace"], c["text"]) for c in extraction.find("Vedi Corte EDU, Rossi c. Italia; art. 2043bis c.c., articolo 3 Costituzione. Secondo la dottrina.") if c["channel"] == "outside"]
    assert found == [("CEDU", "Corte EDU, Rossi c"), ("CODE", "art. 2043bis c.c."), ("CODE", "articolo 3 Costituzione"), ("DOCTRINE", "dottrina")]
    assert extraction.find("") == []


def test_fast_path(spark):
    texts = [
        "La Cassazione ha chiarito; la sentenza citata. ECLI:IT:CASS:2024:1234CIV", "Si veda ECLI:IT:CASS:2024:1234CIV.", "Si veda la Corte EDU, Rossi contro Italia.", "[x](https://a.example/ECLI_IT_CASS_2024_1234CIV)", "[x](https://a.example/altro)", "nulla", None, "ECLI:IT:COST:2010:5 e Tribunale di Roma",
    ]
    got = {r.id: r.settled for r in extraction.fast_path(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [False, True, True, True, False, False, False, False]


def test_ladder_of_raw_texts(spark):
    source = "Vedi Cass. n. 12/2020 e l’art. “x”; Trib. Roma n. 7/2001 e ancora n. 7/2001."
    items = [(1, 1, source, "Cass. n. 12/2020", None, None, None), (2, 1, source, 'l\'art. "x"', None, None, None), (3, 1, source, "sentenza n. 12 del 2020", None, None, "CASS"), (4, 1, source, "sent. n. 7/2001 Roma", None, None, None), (5, 1, source, "n. 99/2021", None, None, None), (6, 1, source, "la nota", None, None, None), (7, 1, source, None, "12", "2020", None), (8, 1, None, "x", None, None, None), (9, 1, source, "sentenza 12/2020", None, None, "TAX")]
    parsed = spark.createDataFrame([(1, "12", 2020, "CASS", False, 5, 21), (1, "7", 2001, "MER", False, 40, 60), (1, "7", 2001, "MER", False, 70, 80)], "id long, number string, year int, namespace string, outside boolean, start int, end int")
    got = {r.item: (r.category, r.reason, r.start) for r in extraction.ladder(spark.createDataFrame(items, "item long, id long, source string, raw string, number string, year string, namespace string"), parsed).collect()}
    assert [got[i][0] for i in range(1, 8)] == ["raw_text_exact", "raw_text_normalized_match", "raw_text_recovered_by_unique_identifier", "raw_text_ambiguous_in_source", "raw_text_identifier_not_in_source", "raw_text_not_verbatim", "raw_text_missing"]
    assert got[3][2] == 5 and got[4][1] == "multiple_identifier_matches" and got[6][1] == "missing_number_or_year" and got[9] == ("raw_text_not_verbatim", "no_compatible_span", None)


def test_sector_conflicts(spark):
    rows = (("ECLI:IT:CASS:2020:1PEN", "CASS", 2020, 1, "PEN", None, None), ("ECLI:IT:CASS:2020:2CIV", "CASS", 2020, 2, "CIV", None, "SU"), ("ECLI:IT:CASS:2020:3CIV", "CASS", 2020, 3, "CIV", None, "L"), ("ECLI:IT:CASS:2020:4CIV", "CASS", 2020, 4, "CIV", None, None))
    asked = [(i, 1, "t", "x", f"ECLI:IT:CASS:2020:{n}", None, None, None, None, "L", None, False) for i, n in enumerate(("1PEN", "2CIV", "3CIV", "4CIV"))]
    routed = resolution.route(resolution.components(spark.createDataFrame(asked, CITATION)))
    got = {r.citation_id: (r.mismatch, r.incomplete) for r in resolution.with_diagnostics(routed, resolution.current_registry(registry(spark, *rows)), "target").collect()}
    assert got == {0: (["sector"], ["division"]), 1: (["sector", "division"], []), 2: ([], ["division"]), 3: ([], ["sector", "division"])}


def test_prefixes_are_capped_in_order(spark):
    rows = [(f"ECLI:IT:CONT:2020:{n}LAZ", "CONT", 2020, n, None, None, None) for n in (12, 300, *range(1200, 1240))]
    asked = [(1, 1, "t", "Corte conti n. 12/2020", None, "CONT", "12", 2020, None, None, None, False), (2, 1, "t", "x", None, "CONT", "9", 2020, None, None, None, False)]
    routed = resolution.route(resolution.components(spark.createDataFrame(asked, CITATION)))
    hits = resolution.prefix_hits(routed, resolution.current_registry(registry(spark, *rows))).collect()
    assert [r.hit for r in sorted(hits, key=lambda r: r.place)] == sorted(r[0] for r in rows if ":12" in r[0])[:25]  # the cap comes first: digits sort before letters
    assert "ECLI:IT:CONT:2020:12LAZ" not in {r.hit for r in hits}
