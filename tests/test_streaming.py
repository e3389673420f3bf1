import json
import time

from pyspark.sql import functions as F

from tidepool.sources.memory import rounds
from tidepool.streaming import imports, sessions

DATA = "/root/testdata/sf0.001"
DELTAS = {"click": (0.02, 0.01), "view": (0.0, 0.0), "purchase": (0.05, 0.05), "error": (-0.10, 0.10), "signup": (0.20, 0.05)}


def mood_events(df):
    pick = lambda i: F.coalesce(*[F.when(F.col("event_type") == k, v[i]) for k, v in DELTAS.items()], F.lit(0.0))
    return df.select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), pick(0).alias("d_valence"), pick(1).alias("d_arousal"), F.lit(0.0).alias("d_defensiveness"))


def run(query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return query.sparkSession.table(name)


def streamed(spark, tmp_path):
    """Events as two files by time, read one a micro-batch."""
    events = spark.read.parquet(f"{DATA}/events.parquet").orderBy("ts", "event_id")
    middle = events.approxQuantile("event_id", [0.5], 0.0)
    cut = spark.read.parquet(f"{DATA}/events.parquet").select(F.expr("percentile_approx(ts, 0.5)").alias("t")).collect()[0].t
    for i, part in enumerate((events.where(F.col("ts") <= F.lit(cut)), events.where(F.col("ts") > F.lit(cut)))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    assert middle
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events"), events


def test_rounds_equal_batch(spark, tmp_path):
    stream, _ = streamed(spark, tmp_path)
    fed = stream.select(F.col("user_id").alias("session_id"), "event_id", F.get_json_object("props", "$.k").cast("long").alias("bucket_id"), F.col("ts").cast("timestamp_ntz").alias("completed_at"))
    got = run(sessions.numbered_rounds(fed), "round_sink")
    key = ["session_id", "round_id", "bucket_id", "completed_at"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, rounds(spark, DATA).select(key).collect()))


def test_moods_equal_batch(spark, tmp_path):
    stream, events = streamed(spark, tmp_path)
    got = run(sessions.streamed_moods(mood_events(stream)), "mood_sink")
    want = sessions.moods(mood_events(events))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.where("valence NOT BETWEEN 0 AND 1 OR arousal NOT BETWEEN 0 AND 1").count() == 0


def test_mood_step():
    s = sessions.PersonaSettings()
    rested = sessions.mood_step(dict.fromkeys(sessions.REST, 1.0), 90, {}, s)
    assert {k: round(v, 2) for k, v in rested.items()} == {"valence": 0.78, "arousal": 0.67, "defensiveness": 0.56}
    pushed = sessions.mood_step(dict(sessions.REST), 0, dict.fromkeys(sessions.REST, 10.0), s)
    assert {k: round(v, 2) for k, v in pushed.items()} == {"valence": 0.74, "arousal": 0.52, "defensiveness": 0.15}
    assert sessions.mood_step(dict(sessions.REST), -5, {"valence": float("nan")}, s)["valence"] == sessions.REST["valence"] - 0.18


def test_reasoning_cache(spark, tmp_path):
    rows = [(1, 1, ["idx:0:f:{}"], "because"), (1, 2, ["idx:0:f:{}"], None), (1, 3, ["idx:0:g:{}"], None), (1, 4, [], None), (1, 5, ["idx:0:f:{}"], None), (2, 6, ["idx:0:f:{}"], None)]
    schema = "session_id long, seq long, signature array<string>, reasoning string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/m")
    q = sessions.cached_reasoning(spark.readStream.schema(schema).parquet(f"{tmp_path}/m")).writeStream.format("memory").queryName("reason_sink").outputMode("append").start()
    end = time.time() + 120
    while spark.table("reason_sink").count() < len(rows) and time.time() < end:
        time.sleep(0.2)
    q.stop()
    got = spark.table("reason_sink")
    assert {r.seq: r.reasoning for r in got.collect()} == {1: "because", 2: "because", 3: None, 4: None, 5: None, 6: None}


def test_import_goes_on(spark, tmp_path):
    folder, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    log = "\n".join(f"User: question {i} with a few words\nAI: answer {i}" for i in range(30))
    (tmp_path / "in/a.txt").write_text(log)
    imports.run_import(spark, folder, out, state, 60).awaitTermination(240)
    first = spark.read.parquet(out).count()
    (tmp_path / "in/b.json").write_text(json.dumps({"messages": [{"role": "user", "content": "hi"}]}))
    (tmp_path / "in/copy.txt").write_text(log)
    imports.run_import(spark, folder, out, state, 60).awaitTermination(240)
    table = spark.read.parquet(out)
    assert first > 3 and table.count() == first + 1 == table.select("chunk_id").distinct().count()
    assert imports.progress(table).agg(F.sum("turns")).collect()[0][0] == 61


def test_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select(F.get_json_object("props", "$.k").cast("long").alias("bucket_id"), F.col("ts").cast("timestamp").alias("at"))
    events.coalesce(1).write.parquet(f"{tmp_path}/e")
    q = sessions.activation_windows(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")).writeStream.format("memory").queryName("window_sink").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = spark.sql("SELECT bucket_id, start, max(hits) AS hits FROM window_sink GROUP BY 1, 2")
    want = events.groupBy("bucket_id", F.window("at", "1 day").start.alias("start")).agg(F.count("*").alias("hits"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
