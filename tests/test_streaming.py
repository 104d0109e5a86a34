from datetime import datetime, timedelta

from larder.streaming import checks as stream


def test_windows(spark, tmp_path):
    at = datetime(2026, 1, 1)
    rows = [("a", 2, "pass", at), ("a", 2, "fail", at + timedelta(minutes=1)), ("a", 3, "skip", at + timedelta(minutes=7)), ("b", 2, "warn", at + timedelta(hours=2))]
    spark.createDataFrame(rows, stream.EVENT_SCHEMA).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(stream.EVENT_SCHEMA).parquet(str(tmp_path / "in"))
    stream.write_parquet(stream.status_by_window(events), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r["start"], r["step"]): (r["status"], r["n_fail"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[at, 2] == ("fail", 1) and got[at + timedelta(minutes=5), 3] == ("skip", 0)
