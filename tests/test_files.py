import json
import sqlite3
import zipfile

import pytest

from giurispark.operators import corpus, matching
from giurispark.sources import files, sinks


def test_zip_corpus(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        meta = {"crMetadata": {"division": "Sez. 5", "legalArea": "civ ", "docType": "SENT", "publicationDate": "20200101"}}
        z.writestr("a/ECLI_IT_CASS_2020_1CIV/info.json", json.dumps({"facts": "perché " * 40, "principles": ["p"], "decision": None}, ensure_ascii=False).encode("latin-1"))
        z.writestr("a/ECLI_IT_CASS_2020_1CIV/metadata.json", json.dumps(meta))
        z.writestr("a/ECLI_IT_CASS_2020_2CIV/info.json", "{}")
        z.writestr("__MACOSX/ECLI_IT_CASS_2020_3CIV/info.json", "{}")
    rows = {r.ecli_id: r for r in files.rulings_from_zip(spark, str(tmp_path / "c.zip")).collect()}
    assert set(rows) == {"ECLI_IT_CASS_2020_1CIV", "ECLI_IT_CASS_2020_2CIV"}
    assert rows["ECLI_IT_CASS_2020_1CIV"].macro_area == "diritto_tributario" and rows["ECLI_IT_CASS_2020_1CIV"].facts.startswith("perché")
    assert rows["ECLI_IT_CASS_2020_2CIV"].problem == "missing_file"


def test_reject_order(spark):
    long = "x" * 200
    rows = [("ECLI_IT_COST_1", "Sez. 1", "CIV", long, ["p"]), ("ECLI_IT_CASS_1", "Sez. 7", "CIV", "", []), ("ECLI_IT_CASS_2", "Sez. 9", "CIV", long, ["p"]), ("ECLI_IT_CASS_3", "Sez. 1", "CIV", None, ["p"]), ("ECLI_IT_CASS_4", "Sez. 1", "CIV", long, None), ("ECLI_IT_CASS_5", "Sez. 1", "PEN", long, ["p"])]
    df = spark.createDataFrame(rows, "ecli_id string, division string, legal_area string, facts string, principles array<string>")
    assert [r.reason for r in df.withColumn("reason", corpus.reject_reason(df)).collect()] == ["not_cassation", "excluded_division", "unmapped", "short_facts", "no_principles", "ok"]


def test_jsonl_tasks_scores_answers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"ecli_id": "E1", "macro_area": "penale"}\n\nkaputt\n')
    good, bad = files.jsonl(spark, str(tmp_path / "c.jsonl"), files.RULING)
    assert good.count() == 1 and bad.count() == 1
    for i in (1, 2):
        d = tmp_path / "tasks" / str(i)
        d.mkdir(parents=True)
        (d / "task.json").write_text(json.dumps({"task_id": f"a/{i}", "query": "q", "criteria": []}) if i == 1 else "{")
    assert [r.task_id for r in files.tasks(spark, str(tmp_path / "tasks")).collect()] == ["a/1"]
    for path in ("m/20240101_0100", "m/20240201_0100", "bullshit/m/20240101_0100", "charts/m/x"):
        d = tmp_path / "res" / path
        d.mkdir(parents=True)
        (d / "scores.json").write_text(json.dumps([{"task_id": "a/1", "model": "m", "model_output": "x", "response": ""}, {"task_id": "a/2", "model_output": " "}]))
    got = files.scores(spark, str(tmp_path / "res"))
    assert {(r.family, r.folder, r.run_timestamp) for r in got.collect()} == {("standard", "m", "20240101_0100"), ("standard", "m", "20240201_0100"), ("bullshit", "m", "20240101_0100")}
    assert {r.run_timestamp for r in files.scores(spark, str(tmp_path / "res"), since="20240115").collect()} == {"20240201_0100"}
    assert [(r.task_id, r.answer) for r in files.answers(spark, str(tmp_path / "res/m/20240101_0100")).collect()] == [("a/1", "x")]


def test_sheets_and_columns(spark, tmp_path):
    (tmp_path / "s.csv").write_text('﻿Domanda;Risposte\n"a;b";"c\nd"\n', encoding="utf-8")
    df = files.sheet(spark, str(tmp_path / "s.csv"), required=("Domanda", "Risposte"))
    assert [tuple(r) for r in df.collect()] == [("a;b", "c\nd")]
    with pytest.raises(ValueError):
        files.sheet(spark, str(tmp_path / "s.csv"), required=("Altro",))
    assert files.first_column(["B", "a"], ("A", "b")) == "a"
    with pytest.raises(ValueError):
        files.only_column(["a", "b"], ("a", "b"))


def test_registry_profiles_ids(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "r.db")
    con.executescript("CREATE TABLE registry (ecli TEXT PRIMARY KEY, namespace TEXT, court TEXT, year INT, number INT, legal_area TEXT, variant TEXT, doc_type TEXT, sector TEXT, publication_date TEXT); CREATE TABLE meta (key TEXT, value TEXT); INSERT INTO meta VALUES ('namespaces', 'CASS'); INSERT INTO registry VALUES ('ECLI:IT:CASS:2024:1CIV', 'CASS', 'CASS', 2024, 1, 'CIV', NULL, NULL, NULL, NULL);")
    con.commit()
    con.close()
    df, meta = files.registry_from_sqlite(spark, str(tmp_path / "r.db"), str(tmp_path / "r.parquet"))
    assert df.count() == 1 and meta == {"namespaces": "CASS"}
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.json").write_text(json.dumps({"task_id": "t", "resolving_rulings": [{"ecli": "ecli_it_cass_2024_1civ", "evidence_tiers": ["x"], "extra": 1}], "retrieved_marginal": [{"ecli": "ECLI:IT:CASS:2024:2CIV"}]}))
    assert {(r.ecli, r.resolving) for r in files.profiles(spark, str(tmp_path / "p")).collect()} == {("ECLI:IT:CASS:2024:1CIV", True), ("ECLI:IT:CASS:2024:2CIV", False)}
    (tmp_path / "ids.txt").write_text("# c\na\n\n b # x\n")
    assert [r.id for r in files.ids(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, None), ("a", 1, 0.5)], "k string, n int, r double")
    sinks.report(df, str(tmp_path / "r.csv"), ["k"], bom=True)
    assert (tmp_path / "r.csv").read_text(encoding="utf-8-sig").splitlines()[1].startswith("a,1")
    assert sinks.summary(df.where("k = 'b'"), str(tmp_path / "s.json"))["r"] is None
    assert "n.d." in sinks.markdown(df, "t")
    new = spark.createDataFrame([("a", 9, None)], df.schema)
    assert {(r.k, r.n) for r in sinks.upserted(df, new, "k").collect()} == {("a", 9), ("b", 2)}
    folder = sinks.run_folder(str(tmp_path), "m/x:1", "20240101", "bullshit")
    (folder / "f.txt").write_text("x")
    assert folder.as_posix().endswith("bullshit/m-x-1/20240101")
    assert list(sinks.bundle(str(folder), str(tmp_path / "b.zip"))) == ["f.txt"]


def test_matching_and_samples(spark):
    left, right = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("b",), ("c",), ("c",)], "id string")
    assert sorted((r.id, r.problem) for r in matching.missing_and_extra(left, right, "id").collect()) == [("a", "missing"), ("c", "duplicate"), ("c", "extra")]
    with pytest.raises(ValueError):
        matching.require_none(left, "x")
    ids = spark.range(100).withColumnRenamed("id", "k")
    assert matching.sampled(ids, "k", 500, 1).count() == 100
    assert {r.k for r in matching.sampled(ids, "k", 7, 1).collect()} == {r.k for r in matching.sampled(ids.repartition(5), "k", 7, 1).collect()}


def test_outputs_and_bounds(spark, tmp_path):
    path = tmp_path / "outputs.json"
    path.write_text(json.dumps([{"task_id": " a ", "model": "m1", "response": " sì "}, {"task_id": "b", "response": "  "}, {"task_id": "", "response": "x"}]), encoding="utf-8")
    model, answers, ids = files.outputs(spark, str(path))
    assert model == "m1" and [tuple(r) for r in answers.collect()] == [("a", "sì")] and sorted(r[0] for r in ids.collect()) == ["a", "b"]
    path.write_text("[]", encoding="utf-8")
    with pytest.raises(ValueError):
        files.outputs(spark, str(path))
    sinks.markdown_file(spark.range(2), "t", str(tmp_path / "t.md"))
    assert (tmp_path / "t.md").read_text(encoding="utf-8").splitlines()[-1] == "| 1 |"
    before, sinks.REPORT_ROWS = sinks.REPORT_ROWS, 1
    try:
        with pytest.raises(ValueError):
            sinks.report(spark.range(2), str(tmp_path / "t.csv"), ["id"])
    finally:
        sinks.REPORT_ROWS = before
