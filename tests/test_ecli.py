import pytest
from pyspark.sql import functions as F

from giurispark.functions import ecli, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [
    ("ECLI:IT:CASS:2024:1234CIV", "ECLI:IT:CASS:2024:1234CIV"), (" ecli_it_cass_2024_1234civ\n", "ECLI:IT:CASS:2024:1234CIV"),
    ("https://archivio.example/pronunce/ECLI_IT_CASS_2024_1234CIV", "ECLI:IT:CASS:2024:1234CIV"), ("(v. ECLI:IT:CASS:2024:1234CIV)", "ECLI:IT:CASS:2024:1234CIV"),
    ("ECLI:IT:X:24:1:2", "ECLI:IT:X:24:12"), ("n. 5 del 2020", None), ("", None), (None, None),
])
def test_canonical(spark, raw, want):
    assert one(spark, ecli.canonical(F.col("v")), v=raw) == want


@pytest.mark.parametrize("raw, plain, padded", [("007", "7", "00000007"), ("0", "0", "00000000"), ("123456789", "123456789", "123456789"), ("12a", None, None), (None, None, None)])
def test_numbers(spark, raw, plain, padded):
    assert one(spark, ecli.number(F.col("v")), v=raw) == plain
    assert one(spark, ecli.padded_number(F.col("v")), v=raw) == padded


@pytest.mark.parametrize("raw, want", [("2024", 2024), (" 1999 ", 1999), ("0999", None), ("24", None), ("20245", None), (None, None)])
def test_year(spark, raw, want):
    assert one(spark, ecli.year(F.col("v")), v=raw) == want


@pytest.mark.parametrize("authority, court", [("Tribunale di Milano", "TRMI"), ("Corte d'Appello di Reggio Calabria", "CARC"), ("Consiglio di Stato", "CDS"), ("TAR Roma", "TARRM"), ("tribunale di nessundove", None)])
def test_authority(spark, authority, court):
    assert one(spark, ecli.authority_court(text.ascii_words(F.col("v")), F.lit(None).cast("string")), v=authority) == court


@pytest.mark.parametrize("raw, want", [
    ("Responsabilità civile", "diritto_civile"), ("PRIVACY e procedura civile", "diritto_civile"), ("crisi d'impresa", "diritto_commerciale"), ("diritto_penale_minorile", "diritto_penale"),
    ("esecuzione penale", "diritto_penale"), ("Diritto del Lavoro", "diritto_lavoro"), ("ignota & nuova", "ignota_e_nuova"), (None, ""),
])
def test_area(spark, raw, want):
    assert one(spark, text.area(F.col("v")), v=raw) == want


def test_strict_area_fails(spark):
    with pytest.raises(Exception, match="unknown area"):
        one(spark, text.area(F.col("v"), strict=True), v="ignota")


def test_normalisers_are_idempotent(spark):
    assert one(spark, ecli.canonical(ecli.canonical(F.col("v"))), v="ecli_it_cass_2024_5pen") == "ECLI:IT:CASS:2024:5PEN"
    assert one(spark, text.area(text.area(F.col("v"))), v="previdenza") == "diritto_lavoro"


def test_preview_redact_json(spark):
    assert one(spark, text.preview(F.col("v"), 5), v=" a  b c d ") == "a b c..."
    assert one(spark, text.redacted(F.col("v")), v="x sk-ant-abc123\ny AIzaXYZ") == "x [redacted] y [redacted]"
    assert one(spark, text.json_object(F.col("v")), v='bla {"a": 1} bla') == '{"a": 1}'
    assert one(spark, text.percent(F.col("v").cast("double"), comma=True), v="0.123") == "12,3%"
