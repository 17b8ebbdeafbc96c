"""Review runs: the stream over several batches and a restart gives what the replay gives."""

import time

from pyspark.sql import functions as F

from glossa.plans import registry  # noqa: F401, I001 - first: the modules register themselves
from glossa.plans.import_queries import EVENT_KIND
from glossa.streaming import runs


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("order"), F.expr(EVENT_KIND).alias("kind")).where("key < 8")


def test_stream_with_restart_is_the_replay(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", runs.ROCKS)
    log = events(spark, sf)
    bounds = log.agg(F.max("order")).first()[0] // 3 + 1
    source = tmp_path / "in"
    source.mkdir()

    def go(name):
        stream = spark.readStream.schema("key long, order long, kind string").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        out = runs.run_stream(stream)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None, name

    for part in range(3):  # each start goes on from the checkpoint of the one before
        log.where((F.col("order") >= part * bounds) & (F.col("order") < (part + 1) * bounds)).coalesce(1).write.parquet(str(source / f"p{part}"))
        go(part)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    want = {(r.key, r.run): r for r in runs.replay(log).collect()}
    ended = {(r.key, r.run): r for r in out if r.event != "dropped"}
    assert ended.keys() == {k for k, r in want.items() if r.status != "open"}
    assert all((r.event, r.done, r.failed, r.partial) == (want[k].status, want[k].done, want[k].failed, want[k].partial) for k, r in ended.items())
    late = {}
    for r in out:
        if r.event == "dropped":
            late[r.key, r.run] = late.get((r.key, r.run), 0) + 1
    assert late == {k: r.dropped for k, r in want.items() if r.dropped}
    assert any(r.event == "cancelled" for r in out) and late


def test_silent_runs_expire(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", runs.ROCKS)
    source = tmp_path / "in"
    schema = "key long, order long, kind string"
    spark.createDataFrame([(1, 1, "start"), (1, 2, "result"), (2, 3, "start"), (2, 4, "finish")], schema).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    q = runs.run_stream(stream, patience_ms=500).writeStream.format("memory").queryName("expiring").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 120
        while time.time() < until and spark.table("expiring").where("event = 'expired'").count() == 0:
            time.sleep(1)
        got = {(r.key, r.event, r.done, r.partial) for r in spark.table("expiring").collect()}
    finally:
        q.stop()
    assert got == {(1, "expired", 1, True), (2, "finished", 0, False)}


def test_replay_of_nothing(spark):
    assert runs.replay(spark.createDataFrame([], "key long, order long, kind string")).collect() == []
    only = spark.createDataFrame([(1, 1, "result"), (1, 2, "cancel")], "key long, order long, kind string")
    assert runs.replay(only).collect() == []
