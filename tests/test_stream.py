import datetime as dt

from giurispark.streaming import ingest

SCHEMA = "score_id long, criterion_id string, judge_id string, verdict string, status string, voted_at timestamp_ntz"


def test_stream_drops_repeats(spark, tmp_path):
    rows = [(1, "C", "A", "pass", "ok", dt.datetime(2024, 1, 1))] * 2 + [(1, "C", "B", "fail", "ok", dt.datetime(2024, 1, 1)), (1, "C", "C", None, "error", dt.datetime(2024, 1, 1))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    seen = []
    votes = ingest.vote_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    ingest.run(ingest.hourly_verdicts(votes), str(tmp_path / "cp"), lambda df, _: seen.extend(df.collect()), "complete").awaitTermination()
    assert {(r.judge, r.verdict, r.votes) for r in seen} == {("A", "pass", 1), ("B", "fail", 1)}
