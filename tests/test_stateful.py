"""Streams with state and timers against their batch forms, late and out-of-order rows included."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import pressure as P
from siftline.streaming import stateful

MINUTE = 60_000_000
SCHEMA = "id long, ord long, at timestamp, op string, level double"


def run(spark, folder, batches, make, out):
    """Rows of a stream over files that come one at a time, and the watermark it has reached."""
    stateful.keep_state(spark)
    src, state = f"{folder}/in", f"{folder}/state"
    query = None
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(k, o, None, op, v, m) for k, o, m, op, v in rows], SCHEMA + ", micros long").withColumn("at", F.timestamp_micros("micros")).drop("micros")
        df.coalesce(1).write.mode("append").parquet(src)
        stream = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src))
        # every batch is a run of its own, so that state and timers outlive the query
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def upto(rows, late):
    return (max(m for b in rows for *_, m, _, _ in b) - late) // 1000 * 1000


@pytest.mark.parametrize("seed", [1, 2])
def test_pressure(spark, tmp_path, seed):
    r = random.Random(seed)
    start = 1_700_000_000_000_000
    rows = [(r.randrange(4), i, start + r.randrange(600) * MINUTE + r.randrange(1000) * 1000, "x", r.choice([5.0, 5.0, 5.0, 1.0, None])) for i in range(160)]
    rows += [rows[3], rows[8], (None, 900, start, "x", 5.0)]
    rows.sort(key=lambda x: x[2] + r.randrange(30) * MINUTE)  # out of order by less than the delay
    batches = [rows[i : i + 40] for i in range(0, len(rows), 40)]
    late = [(0, 5000 + i, start + i * MINUTE, "x", 5.0) for i in range(3)]  # behind every watermark
    end = [(9, 9999, start + 700 * MINUTE, "x", 1.0)]
    make = lambda e: stateful.pressure_stream(e, "id", "at", "ord", F.col("level") > 2, 7 * MINUTE, "31 minutes")
    run(spark, str(tmp_path), [*batches, end, late], make, f"{tmp_path}/out")
    mark = upto([rows, end], 31 * MINUTE)
    kept = spark.createDataFrame([(k, o, m, v) for k, o, m, _, v in rows + end], "id long, ord long, at long, level double")
    want = P.pressure_fires(kept, "id", "at", "ord", F.col("level") > 2, 7 * MINUTE, mark)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("id", "began", "step", "fired").collect()))
    assert got == sorted(map(tuple, want.collect())) and len({b for _, b, *_ in got}) > 10 and max(s for *_, s, _ in got) > 2


def brute_moves(rows, ttl, until):
    out, items = [], {}
    for k, o, m, op, _ in rows:
        if k is not None and m is not None and op is not None:
            items.setdefault(k, []).append((m, o, op))
    for k, events in items.items():
        opened = min((e for e in events if e[2] == "queue"), default=None)
        if opened and opened[0] + ttl <= until:
            events.append((opened[0] + ttl, P.LAST, "expire"))
        status = None
        for m, o, op in sorted(events):
            to = {"queue": "pending"}.get(op) if status is None else P.MOVES.get(op) if status == "pending" else {"reply": "replied", "expire": "expired"}.get(op) if status == "replied" else None
            if to:
                out.append((k, m, o, op, status, to))
                status = to
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_approvals(spark, tmp_path, seed):
    r = random.Random(seed)
    start = 1_700_000_000_000_000
    ops = ["queue", "approve", "reject", "reply", "reply", "expire", "noise", None]
    rows = [(r.randrange(30), i // 2, start + r.randrange(300) * MINUTE, r.choice(ops), 0.0) for i in range(300)]
    rows += [rows[5], (None, 1, start, "queue", 0.0)]
    rows.sort(key=lambda x: x[2] + r.randrange(20) * MINUTE)
    end = [(99, 10**6, start + 500 * MINUTE, "queue", 0.0)]
    mark = upto([rows, end], 21 * MINUTE)
    want = brute_moves(rows + end, 45 * MINUTE, mark)
    df = spark.createDataFrame([(k, o, m, op) for k, o, m, op, _ in rows + end], "id long, ord long, at long, op string")
    batch = [tuple(x) for x in P.approval_moves(df, 45 * MINUTE, mark).select("id", "at", "ord", "op", "before", "after").collect()]
    assert sorted(batch, key=str) == want
    assert {x[5] for x in want} == {"pending", "approved", "rejected", "replied", "expired"}
    late = [(0, 7, start, "queue", 0.0), (77, 8, start, "queue", 0.0)]
    make = lambda e: stateful.approval_stream(e, "at", 45 * MINUTE, "21 minutes")
    run(spark, str(tmp_path), [rows[:100], rows[100:220], rows[220:], end, late], make, f"{tmp_path}/out")
    got = [tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").select("id", "at", "ord", "op", "before", "after").collect()]
    assert sorted(got, key=str) == [x for x in want if x[0] != 99]  # the last item waits for its watermark


@pytest.fixture(autouse=True)
def few_partitions(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


def test_empty(spark):
    none = spark.createDataFrame([], "id long, ord long, at long, op string, level double")
    assert P.approval_moves(none, 5, 10).count() == 0
    assert P.pressure_fires(none, "id", "at", "ord", F.col("level") > 2, 5, 10).count() == 0
