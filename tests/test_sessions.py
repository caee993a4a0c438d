"""Sessions over a stream against the same rows in one batch."""

import datetime
import random

from terraloom.streaming import sessions as T

ROW = "key long, ts timestamp, ordinal long, action string"


def test_stream_equals_batch_whatever_the_order(spark, tmp_path):
    rng = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(seconds=rng.randrange(600)), n, rng.choice(["right", "wrong", "skip", "right", "right"])) for k in range(5) for n in range(40)]
    batch = {tuple(r) for r in T.fold_sessions(spark.createDataFrame(rows, ROW), 6).collect()}
    shuffled = rng.sample(rows, len(rows))
    source, seen = tmp_path / "in", {}
    source.mkdir()
    # Three files in any order within the delay, then one row of another key that moves the watermark past all of them, and a last one past the idle time.
    parts = [shuffled[:70], shuffled[70:140], shuffled[140:], [(99, start + datetime.timedelta(hours=3), 0, "skip")], [(99, start + datetime.timedelta(days=3), 1, "skip")]]

    def gather(df, _):
        for r in df.collect():
            assert r.key == 99 or r.key not in seen or seen[r.key] == tuple(r)
            seen[r.key] = tuple(r)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        events = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = T.stream_sessions(events, 6, delay="1 hour", idle="1 hour").writeStream.outputMode("update").foreachBatch(gather).option("checkpointLocation", str(tmp_path / "state")).start()
        for k, part in enumerate(parts):
            spark.createDataFrame(part, ROW).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
            for f in (tmp_path / f"p{k}").glob("*.parquet"):
                f.rename(source / f"{k}.parquet")
            query.processAllAvailable()
        left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        query.stop()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {v for k, v in seen.items() if k != 99} == batch
    assert left == 1  # only the last key's state is still there
