import json
import random
import time

from tidepool.streaming.server_events import messages_of, messages_of_events, streamed_events

SCHEMA = "stream_id long, seq long, chunk binary"
OUT = "stream_id long, at long, event binary"


def event(**delta):
    return f"data: {json.dumps({'choices': [{'delta': delta}]}, ensure_ascii=False)}\r\n\r\n"


def streams():
    call = lambda i, **f: {"index": i, "function": f}
    one = event(role="assistant", content="猫") + event(content=" é🙂") + event(reasoning_content="why", tool_calls=[call(1, name="g")]) + event(tool_calls=[call(0, name="f", arguments='{"a"'), call(0, arguments=":1}")]) + "data: {bad\n\n\n\n: ping\r\n\r\ndata: [DONE]\n\n"
    two = "data: " + json.dumps({"choices": [{"message": {"content": "said"}}]}) + "\n\n" + event(content=" on") + event(content="\r\n!")
    return {1: one.encode(), 2: two.encode(), 3: b": ping\n\n", 4: event(content="bad ").encode() + b'data: {"choices": [{"delta": {"content": "\xff\xe7"}}]}\n\n'}


def until(done, seconds=40):
    end = time.time() + seconds
    while not done():
        assert time.time() < end
        time.sleep(0.1)


def run(spark, tmp_path, name, batches, idle=60.0):
    """The events after all batches, each a file of its own and a micro-batch."""
    folder = tmp_path / name
    folder.mkdir()
    chunks = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = streamed_events(chunks, idle).writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-state").start()
    sent = 0
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{name}-{i}")
            for p in (tmp_path / f"{name}-{i}").glob("*.parquet"):
                p.rename(folder / f"{i:03}.parquet")
            sent += len(rows)
            # Timeouts keep batches going without input, so that processAllAvailable doesn't return.
            until(lambda: sum(x["numInputRows"] for x in q.recentProgress) >= sent)  # noqa: B023
        if idle < 1:
            until(lambda: spark.read.schema(OUT).parquet(f"{tmp_path}/{name}-out").count() == 2)
    finally:
        q.stop()
    return spark.read.schema(OUT).parquet(f"{tmp_path}/{name}-out")


def said(df):
    return sorted(map(str, df.collect()))


def test_any_cut_into_chunks_and_batches_gives_one_result(spark, tmp_path):
    whole = streams()
    want = said(messages_of(spark.createDataFrame([(k, 0, v) for k, v in whole.items()], SCHEMA)))
    assert len(want) == 3
    rnd = random.Random(7)
    for trial in range(3):
        rows = []
        for k, raw in whole.items():
            cuts = sorted({0, len(raw), *(rnd.randrange(len(raw)) for _ in range(len(raw) // (2 if trial else 9)))})
            rows += [(k, i, raw[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]  # noqa: B905
        rows.sort(key=lambda r: r[1])
        batches = [rows[i::4] for i in range(4)] if trial else [rows[i : i + len(rows) // 3 + 1] for i in range(0, len(rows), len(rows) // 3 + 1)]
        batches[-1] += rnd.sample(rows, 5)  # some come again
        events = run(spark, tmp_path, f"cut{trial}", batches)
        assert said(messages_of_events(events)) == want


def test_what_is_unfinished_comes_after_a_while(spark, tmp_path):
    raw = event(content="one").encode() + event(content=" two").encode().rstrip()
    got = run(spark, tmp_path, "idle", [[(1, 0, raw)]], idle=0.02)
    assert [r.at for r in got.orderBy("at").collect()] == [0, 1]
    assert [r.content for r in messages_of_events(got).collect()] == ["one two"]
