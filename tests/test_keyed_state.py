import time

import pytest
from pyspark.sql import functions as F

from tidepool.functions.answers import PERSONALITY, RELATIONSHIP
from tidepool.operators.persona import profiles
from tidepool.streaming import imports, keyed_state, sessions

DATA = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed_state.ROCKSDB)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(query, name, checkpoint):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    return query.sparkSession.table(name)


def arrived(spark, name, n):
    """Wait for so many rows: a query whose state has a time limit always has one more batch to run."""
    end = time.time() + 60
    while spark.table(name).count() < n:
        assert time.time() < end
        time.sleep(0.2)


def persona_log(events):
    step = lambda k, i: (F.pmod(F.col("event_id") * (7 + i), F.lit(41)) / F.lit(2000.0) - 0.008).alias(k)
    deltas = [F.struct(*[step(k, i) for i, k in enumerate(names)]).alias(c) for c, names in (("personality_delta", PERSONALITY), ("relationship_delta", RELATIONSHIP))]
    return events.select(F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("profile_id"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), *deltas, F.lit(None).cast("string").alias("error"))


def test_streamed_profiles_equal_the_batch(spark, tmp_path):
    """Events in files out of order, late ones within the watermark; far later ones push it past all others."""
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", "ts").where("user_id < 6")
    bounds = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()[0]
    part = F.least(F.lit(3), F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(int(bounds.a.timestamp()))) * 4 / F.lit(int((bounds.b - bounds.a).total_seconds()) + 1)))
    swapped = part + F.when(F.pmod("event_id", F.lit(5)) == 0, 1).otherwise(0)  # a fifth comes one file late
    for i in range(5):
        events.where(swapped == i).orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
        time.sleep(1.1)  # files are taken in the order of their times
    for n in range(2):  # the second one lets the first one's watermark be seen
        spark.createDataFrame([(10**9 + 10 * n + u, u, None) for u in range(3)], "event_id long, user_id long, ts timestamp").withColumn("ts", F.lit(bounds.b) + F.expr(f"INTERVAL {40 + n} DAYS")).select(events.columns).select("event_id", "user_id", F.col("ts").cast(events.schema["ts"].dataType).alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
        time.sleep(1.1)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    got = run(keyed_state.streamed_profiles(persona_log(stream), "20 days"), "profile_sink", f"{tmp_path}/c").where("event_id < 1000000000")
    assert got.count() == events.count()
    last = {r.profile_id: r for r in got.groupBy("profile_id").agg(F.max_by(F.struct("*"), F.struct("at", "event_id")).alias("r")).select("r.*").collect()}
    want = {r.profile_id: r for r in profiles(persona_log(events)).collect()}
    assert set(last) == set(want) and len(want) == 3
    for p, r in want.items():
        assert all(abs(r[k] - last[p][k]) < 1e-9 for k in keyed_state.TRAITS)


def test_reasoning_is_forgotten_after_its_time(spark, tmp_path):
    """A busy session: each batch brings a message within the time, but what the first stored is older by then."""
    schema = "session_id long, seq long, signature array<string>, reasoning string"
    write = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/m")
    write((1, 1, ["f"], "because"), (1, 2, ["f"], None))
    cached = sessions.cached_reasoning(spark.readStream.schema(schema).parquet(f"{tmp_path}/m"), 0.2)
    q = cached.writeStream.format("memory").queryName("kept_sink").outputMode("append").start()
    try:
        for rows in ((1, 3, ["g"], "new"), (1, 4, ["h"], None)), ((1, 5, ["f"], None), (1, 6, ["g"], None)):
            arrived(spark, "kept_sink", rows[0][1] - 1)
            time.sleep(7)
            write(*rows)
        arrived(spark, "kept_sink", 6)
    finally:
        q.stop()
    got = {r.seq: r.reasoning for r in spark.table("kept_sink").collect()}
    assert got.pop(6) in ("new", None)  # about as old as its time
    assert got == {1: "because", 2: "because", 3: "new", 4: None, 5: None}


def test_a_pause_holds_the_running_import(spark, tmp_path):
    planned = spark.createDataFrame([(s, f"{s}{i}", i) for s in "ab" for i in range(5)], "source_hash string, chunk_id string, chunk long")
    outcomes, control = f"{tmp_path}/outcomes", f"{tmp_path}/control"
    seen, broken = [], []

    def process(todo):
        seen.append(sorted(r.chunk_id for r in todo.collect()))
        if len(seen) == 1:  # the user pauses a while its first step runs
            spark.createDataFrame([("a",)], "source_hash string").write.mode("overwrite").parquet(control)
        if len(seen) == 3 and not broken:
            broken.append(1)
            raise RuntimeError("crash")
        return todo.select("chunk_id", F.lit(1).alias("api_calls"), F.lit(1).alias("created"), F.lit(0).alias("merged"), F.lit(0).alias("raw"), F.lit(None).cast("string").alias("error"))

    with pytest.raises(RuntimeError, match="crash"):
        imports.process_pending(planned, outcomes, control, process, 2)
    assert seen == [["a0", "a1"], ["b0", "b1"], ["b2", "b3"]]
    assert imports.process_pending(planned, outcomes, control, process, 2) == 2  # the rest of b, from the step that broke
    status = lambda: {r.source_hash: (r.processed, r.status) for r in imports.import_status(planned, spark.read.parquet(outcomes), spark.read.schema("source_hash string").parquet(control)).collect()}
    assert seen[3:] == [["b2", "b3"], ["b4"]] and status() == {"a": (2, "paused"), "b": (5, "completed")}
    spark.createDataFrame([], "source_hash string").write.mode("overwrite").parquet(control)
    assert imports.process_pending(planned, outcomes, control, process, 2, most_steps=1) == 1 and imports.process_pending(planned, outcomes, control, process, 2) == 1
    log = spark.read.parquet(outcomes)
    assert status() == {"a": (5, "completed"), "b": (5, "completed")} and log.count() == log.select("chunk_id").distinct().count() == 10
