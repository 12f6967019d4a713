from datetime import datetime

from lodeworks.streaming.plays import windowed_plays

SCHEMA = "userid string, traid string, loaded_at timestamp_ntz"


def test_daily_plays_of_a_stream(spark, tmp_path):
    day = lambda d, h: datetime(2008, 1, d, h)
    first = [("U1 ", "a", day(1, 1)), ("u1", "b", day(1, 2)), ("u1", "b", day(1, 2)), (" ", "c", day(1, 3)), (None, "c", None)]
    second = [("u1", "b", day(1, 2)), ("u2", "c", day(2, 1)), ("u1", "c", day(2, 1))]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "log" / f"part{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "log"))
    query = windowed_plays(stream, "userid").writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {(r["start"].day, r["key_value"]): r["plays"] for r in spark.table("daily").collect()}
    assert got == {(1, "u1"): 2, (2, "u1"): 1, (2, "u2"): 1}
