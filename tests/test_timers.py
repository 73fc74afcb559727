"""Follow-up timers over several batches."""

import datetime

from jobloom.streaming import timers

DAY = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_timers_of_many_applications_share_a_bucket(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.STATE_STORE)
    landed = str(tmp_path / "rows")
    batches = [
        [(i, 1, "applied", DAY(i % 3)) for i in range(40)] + [(7, 2, "interview", DAY(2)), (8, 2, "applied", DAY(2))],
        [(i, 2, "rejected", DAY(4)) for i in range(1, 40, 4)] + [(900, 1, "interview", DAY(10))],  # the clock passes the first seven days
        [(903, 1, "interview", DAY(10))],
        [(i, 3, "interview", DAY(11)) for i in range(0, 40, 4)] + [(901, 1, "interview", DAY(16))],
        [(902, 1, "interview", DAY(60))],
    ]
    schema = "saved_id long, seq int, status string, changed_at timestamp"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landed)
    events, epoch = timers.followup_events(stream, buckets=3), datetime.datetime(1970, 1, 1)
    events.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.saved_id, r.event, epoch + datetime.timedelta(milliseconds=r.at_ms)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    told = [i for i in range(40) if i % 4 != 1 and i != 7]
    want = [(i, "follow_up", DAY(i % 3 + 7)) for i in told] + [(i, "ghosted", DAY(i % 3 + 14)) for i in told if i % 4]
    assert got == sorted(want)
