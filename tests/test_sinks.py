"""Epoch tables under replay and broken runs, replaced states, SQLite rows."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from siftline.sources import sqlite_rows
from siftline.streaming import sinks

MOVES = "id long, at long, ord long, op string, before string, after string"


def test_a_replayed_batch_writes_once(spark, tmp_path):
    """A stream that lost the record of its last batch runs it again; each approval still has one row a callback."""
    src, check = f"{tmp_path}/in", f"{tmp_path}/check"
    table = sinks.EpochTable(spark, f"{tmp_path}/out")
    put = lambda df: sinks.approval_callbacks(df, ["apply", "tell"])
    for i in range(3):
        rows = [(10 * i + k, k, k, op, "pending", to) for k, (op, to) in enumerate([("approve", "approved"), ("reject", "rejected"), ("approve_all", "approved"), ("approve", "approved")])]
        spark.createDataFrame(rows, MOVES).coalesce(1).write.mode("append").parquet(src)
        sinks.to_table(spark.readStream.schema(MOVES).parquet(src), table, check, put, availableNow=True).awaitTermination()
    assert table.epochs() == [0, 1, 2]
    for name in ("2", ".2.crc"):
        if os.path.exists(f"{check}/commits/{name}"):
            os.remove(f"{check}/commits/{name}")
    calls = []
    sinks.to_table(spark.readStream.schema(MOVES).parquet(src), table, check, lambda df: (calls.append(1), put(df))[1], availableNow=True).awaitTermination()
    assert calls  # the batch did run again
    got = sorted((r.id, r.callback) for r in table.read().collect())
    assert got == sorted((10 * i + k, c) for i in range(3) for k in (0, 3) for c in ("apply", "tell"))


def test_a_broken_run_is_never_read(spark, tmp_path, monkeypatch):
    table = sinks.EpochTable(spark, f"{tmp_path}/t")
    df = spark.range(5)
    table.write(df, 0)
    bad = df.select(F.when(F.col("id") < 9, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        table.write(bad, 1)
    monkeypatch.setattr(table.folder, "move", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        table.write(df, 1)
    assert table.epochs() == [0] and table.read().count() == 5
    monkeypatch.undo()
    assert table.write(df, 1) and not table.write(df.limit(1), 1)
    assert table.read().groupBy("epoch").count().count() == 2 and table.read().count() == 10
    table.clean()
    assert table.folder.names() == ["epoch=0", "epoch=1"]


def test_state(spark, tmp_path):
    state = sinks.State(spark, f"{tmp_path}/s", "json")
    schema = "k string, n long"
    assert state.current(schema).count() == 0
    with pytest.raises(ValueError):
        state.current()
    for i in range(4):
        now = state.current(schema)
        state.replace(now.union(spark.createDataFrame([("a", 1), (None, 2)], schema)).groupBy("k").agg(F.sum("n").alias("n")))
    assert sorted(map(str, ((r.k, r.n) for r in state.current(schema).collect()))) == ["('a', 4)", "(None, 8)"]
    assert state.epochs() == [2, 3]


ROWS = "date string, provider string, cost double, task_id string, n long"


@pytest.fixture()
def costs(spark):
    sqlite_rows.register(spark)
    rows = [("2024-01-%02d" % (i % 28 + 1), ["a", "b", None][i % 3], i / 4, None if i % 5 else str(i), i) for i in range(500)]
    return spark.createDataFrame(rows, ROWS).repartition(4)


def load(spark, path, **options):
    return spark.read.format("sqlite_rows").options(path=path, table="cost_records", **options).load()


def save(df, path, mode="append"):
    df.write.format("sqlite_rows").options(path=path, table="cost_records").mode(mode).save()


def test_sqlite_append_and_read(spark, tmp_path, costs):
    path = f"{tmp_path}/new/costs.db"
    save(costs, path)
    save(costs.where("provider = 'a'"), path)
    assert os.listdir(f"{tmp_path}/new") == ["costs.db"]
    got = load(spark, path, partitions="3")
    assert got.schema.simpleString() == "struct<date:string,provider:string,cost:double,task_id:string,n:bigint>"
    want = costs.union(costs.where("provider = 'a'"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(want) and got.rdd.getNumPartitions() == 3
    terms = ["cost > 20 AND cost <= 90.25", "provider = 'b'", "provider IS NULL AND n >= 100", "task_id IS NOT NULL", "provider IN ('a', 'b') AND n < 50", "n = 7 OR n = 9", "length(date) = 10 AND cost < 3", "NOT n = 5"]
    for term in terms:
        assert key(got.where(term)) == key(want.where(term)), term
    assert got.where("cost > 20").select("n").agg(F.sum("n")).first()[0] == want.where("cost > 20").agg(F.sum("n")).first()[0]
    save(costs.limit(3), path, "overwrite")
    assert load(spark, path).count() == 3


def test_sqlite_filters_reach_the_file(tmp_path):
    path = f"{tmp_path}/c.db"
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE cost_records (provider TEXT, cost REAL)")
        c.executemany("INSERT INTO cost_records VALUES (?, ?)", [("a", 1.0), ("b", 2.0), ("b", 3.0)])
    source = sqlite_rows.SqliteRows({"path": path, "table": "cost_records"})
    reader = source.reader(source.schema())
    from pyspark.sql import datasource as D

    assert list(reader.pushFilters([D.EqualTo(("provider",), "b"), D.StringContains(("provider",), "x"), D.GreaterThan(("cost",), 2.5)])) == [D.StringContains(("provider",), "x")]
    assert [r for p in reader.partitions() for r in reader.read(p)] == [("b", 3.0)]


def test_sqlite_abort_leaves_nothing(spark, tmp_path, costs):
    path = f"{tmp_path}/costs.db"
    save(costs, path)
    bad = costs.withColumn("n", F.when(F.col("n") == 499, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="broken"):
        save(bad, path)
    with pytest.raises(Exception):  # the table has no such column: the commit itself fails
        save(costs.withColumnRenamed("n", "m"), path)
    assert os.listdir(tmp_path) == ["costs.db"] and load(spark, path).count() == 500


def test_sqlite_empty_table(spark, tmp_path, costs):
    path = f"{tmp_path}/costs.db"
    save(costs.limit(0), path)
    assert load(spark, path).count() == 0 and load(spark, path).columns == costs.columns
