"""Streams in append mode: late rows, winners whose state ends, failure and restart, state that shrinks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chipmeter.sources.scratch import scratch_folder
from chipmeter.streaming import submissions as T

SCHEMA = "event_id long, ts timestamp, assignment long, labeler long, verdict string, tags array<string>, edits array<struct<prediction:int,action:string,class:string,ring:array<struct<x:double,y:double>>>>"
DAY0 = dt.datetime(2024, 3, 1)


def submission(i, day, assignment, verdict="accepted"):
    return (i, DAY0 + dt.timedelta(days=day), assignment, i % 3, verdict, [], [])


#: Portions of arrivals, as (id, day, assignment[, verdict]).
ARRIVED = [
    [(1, 0.0, 1, "odd"), (2, 0.2, 1), (3, 0.1, 2), (4, 0.3, 2)],
    [(5, 1.0, 1), (6, 4.0, 3), (7, 0.05, 4)],
    [(8, 9.0, 5), (9, 2.0, 6), (10, 9.5, 1)],  # the watermark here is day 3: the state of 1 and 2 still lives
    [(11, 20.0, 5), (12, 2.5, 7), (13, 19.0, 2)],  # behind day 3, where portion 2 was: 12 is late; day 8.5 has passed 0.1 + 7
    [(14, 21.0, 3), (15, 30.0, 8), (16, 8.0, 9)],  # 16 is behind day 8.5
    [(17, 40.0, 8)],
]
#: Of the rows that aren't late; 10 meets the winner of day 0.2, 13 and 14 come after the state of their assignment has ended; at 17 the watermark is day 29 still.
STATUS = {1: "bad_verdict", 2: "accepted", 3: "accepted", 4: "conflict", 5: "conflict", 6: "accepted", 7: "accepted", 8: "accepted", 9: "accepted", 10: "conflict",
          11: "conflict", 13: "accepted", 14: "accepted", 15: "accepted", 17: "conflict"}


@pytest.fixture
def arrived(spark):
    folder = scratch_folder(spark, "arrivals")
    rows = [submission(*x) for part in ARRIVED for x in part]
    number = F.lit(0)
    for k, part in enumerate(ARRIVED):
        number = F.when(F.col("event_id").isin([x[0] for x in part]), k).otherwise(number)
    table = spark.createDataFrame(rows, SCHEMA)
    T.arrive(table, number, folder)
    return T.arrivals(spark, folder, table.schema)


@pytest.fixture
def known(spark):
    return spark.createDataFrame([(1, 1)], "chip long, prediction int")


def test_first_good_submission_with_state_that_ends(spark, arrived, known):
    out = T.run_available(T.accepted_first(arrived, known), scratch_folder(spark, "streams"))
    assert {r.event_id: r.status for r in out.collect()} == STATUS and out.count() == len(STATUS)


def test_windows_are_reported_once_when_closed(spark, arrived):
    out = T.run_available(T.progress(arrived), scratch_folder(spark, "streams"))
    got = sorted((r.w.start.day if r.w.start.month == 3 else 31 + r.w.start.day, r.labeler, r.n) for r in out.collect())
    late, last = {12}, 39  # the window of 16 ends on day 9, which the watermark (day 8.5) has not reached
    want = {}
    for part in ARRIVED:
        for i, day, *_ in part:
            if i not in late and int(day) + 1 <= last:
                want[int(day) + 1, i % 3] = want.get((int(day) + 1, i % 3), 0) + 1
    assert got == sorted((*k, n) for k, n in want.items())


@pytest.mark.parametrize("job", ["status", "windows"])
def test_a_run_that_fails_half_way_goes_on_with_the_same_rows(spark, arrived, known, job):
    make = (lambda s: T.accepted_first(s, known)) if job == "status" else T.progress
    whole = T.run_available(make(arrived), scratch_folder(spark, "streams"))
    path = scratch_folder(spark, "streams")

    class Broken(Exception):
        pass

    stream = make(arrived)
    tried = []

    def put(batch, number):  # writes as run_available does, but dies after the write of the third batch
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        tried.append(number)
        if number == 2:
            raise Broken("executor lost")

    with pytest.raises(Exception, match="executor lost"):
        stream.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert tried == [0, 1, 2]
    again = T.run_available(make(arrived), path)
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect())) and again.count() > 0


def test_state_shrinks(spark, arrived, known):
    for stream in (T.accepted_first(arrived, known), T.progress(arrived)):
        q = stream.writeStream.outputMode("append").foreachBatch(lambda b, n: b.write.format("noop").mode("overwrite").save()).option("checkpointLocation", scratch_folder(spark, "streams")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in (json.loads(p.json) for p in q.recentProgress) if p["stateOperators"]]
        assert max(rows) > 2 * rows[-1] and rows[-1] <= 2, rows
