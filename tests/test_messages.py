import json

from pyspark.sql import functions as F

from tidepool.functions import answers, messages
from tidepool.streaming.server_events import messages_of


def values(spark, column, *raw):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("raw")).alias("x")).collect()]


def test_analysis(spark):
    full = {"domain": ["a", "b", "c", "d"], "valence": 1.4, "arousal": "0.25", "tags": [str(i) for i in range(20)], "suggested_name": "n" * 30}
    a, b, c, d, e = values(spark, answers.analysis, "```json\n" + json.dumps(full) + "\n```", "oops", "[1]", json.dumps({"valence": "x", "arousal": 0.9}), None)
    assert (a.domain, a.valence, a.arousal, len(a.tags), a.suggested_name) == (["a", "b", "c"], 1.0, 0.25, 15, "n" * 20)
    for x in (b, c, e):
        assert (x.domain, x.valence, x.arousal, x.tags, x.suggested_name) == (["未分类"], 0.5, 0.3, [], "")
    assert (d.valence, d.arousal) == (0.5, 0.3)


def test_items(spark):
    listed = [{"content": "x", "importance": "12", "tags": ["t"] * 12}, {"content": ""}, "no", {"content": "y", "importance": "low", "valence": -3}]
    a, b, c = values(spark, lambda r: answers.items(r, 10), json.dumps(listed), "{}", "no")
    assert [(i.content, i.importance, len(i.tags), i.valence) for i in a] == [("x", 10, 10, 0.5), ("y", 5, 0, 0.0)] and b == [] and c == []


def test_evaluation(spark):
    good = {"event_type": "e" * 50, "affect_delta": {"valence": 10, "arousal": "x"}, "relationship_delta": {"trust": -1}, "confidence": 3}
    a, b, c = values(spark, answers.evaluation, "Sure: ```json\n" + json.dumps(good) + "\n``` done", "nothing", None)
    assert (a.event_type, a.affect_delta.valence, a.affect_delta.arousal, a.relationship_delta.trust, a.personality_delta.openness, a.confidence, a.mood_label) == ("e" * 40, 0.18, -0.18, -0.03, 0.0, 1.0, "warm_neutral")
    assert b is None and c is None


def test_message_text(spark):
    got = values(spark, lambda r: messages.message_text(F.parse_json(r)), '"plain"', '[{"type":"text","text":"a"},{"type":"image"},{"type":"input_text","input_text":"b"},3]', "7", "{}")
    assert got == ["plain", "a\nb", "", ""]


def test_arguments_and_signatures(spark):
    assert messages.normal_arguments('{"b": 1,\n "a": [1, 2]}') == '{"a":[1,2],"b":1}' and messages.normal_arguments("  x   y ") == "x y" and messages.normal_arguments(None) == ""
    calls = spark.createDataFrame([([("c1", "f", "{}"), ("c2", None, None), (None, None, None)],)], "calls array<struct<id:string,name:string,normal_arguments:string>>")
    assert calls.select(messages.signature(F.col("calls"))).collect()[0][0] == ["idx:0:f:{}", "id:c2"]


def test_injection(spark):
    row = spark.range(1).select(messages.injected(F.lit("p"), F.lit("c"), F.lit(""), F.lit(None).cast("string"), 1200).alias("whole"), messages.injected(F.lit("p"), F.lit("word " * 3000), F.lit(""), F.lit("r"), 100).alias("cut")).collect()[0]
    assert row.whole.endswith("Core Memory\nc\n\nRecent Context\n(none)\n\nRecalled Memory\n(none)") and row.whole.startswith(messages.GUIDE)
    assert len(row.cut) < 700
    kinds = "m array<struct<role:string,content:string>>"
    new = F.struct(F.lit("system").alias("role"), F.lit("new").alias("content"))
    rows = spark.createDataFrame([([("system", "s"), ("user", "u")],), ([("user", "u")],), ([],)], kinds).select(messages.insert_message(F.col("m"), new).alias("m")).collect()
    assert [[x.content for x in r.m] for r in rows] == [["s", "new", "u"], ["new", "u"], ["new"]]


def test_descriptions_and_models(spark):
    kinds = "m array<struct<role:string,text:string,reasoning:string,calls:array<struct<id:string,name:string>>>>"
    m = spark.createDataFrame([([("user", " x", None, None), (None, " ", "r", [("i", "n"), (None, "n"), (None, None)])],)], kinds).select(messages.described(F.col("m")).alias("m")).collect()[0].m
    assert [(x.idx, x.role, x.has_text, x.has_reasoning, x.calls) for x in m] == [(0, "user", True, False, None), (1, "", False, True, ["i", "idx:1:n", "idx:2"])]
    assert spark.range(1).select(messages.model_list(F.array(*map(F.lit, [" a", "b", "", "a"])), F.lit("c"))).collect()[0][0] == ["c", "a", "b"]


def test_server_events(spark):
    event = lambda **d: f"data: {json.dumps({'choices': [{'delta': d}]}, ensure_ascii=False)}\r\n\r\n"
    call = lambda i, **f: {"index": i, "function": f}
    stream = event(role="assistant", content="猫") + event(content=" é") + event(reasoning_content="why", tool_calls=[call(1, name="g")]) + event(tool_calls=[call(0, name="f", arguments='{"a"'), call(0, arguments=":1}")]) + "data: {bad\n\ndata: [DONE]\n\n"
    raw = stream.encode()
    instead = event(content="lost") + "data: " + json.dumps({"choices": [{"message": {"content": "said", "tool_calls": [{"id": "c", "type": "t", "function": {"name": "h", "arguments": "{}"}}]}}]}) + "\n\n" + event(content=" on", tool_calls=[call(0, arguments="!")])
    rows = [(n, i, raw[i : i + n]) for n in (1, 5, 7, 1000) for i in range(0, len(raw), n)] + [(2, 0, b": ping\n\n"), (3, 0, b"data: [DONE]\n\n"), (4, 0, instead.encode()), (6, 0, b"data: 7\n\ndata: {\"choices\": [3, {\"delta\": {\"content\": 5}}]}\n\n")]
    got = {r.stream_id: r for r in messages_of(spark.createDataFrame(rows, "stream_id long, seq long, chunk binary")).collect()}
    assert set(got) == {1, 5, 7, 1000, 4}
    for n in (1, 5, 7, 1000):
        assert (got[n].role, got[n].content, got[n].reasoning) == ("assistant", "猫 é", "why")
        assert [c["function"] for c in json.loads(got[n].tool_calls)] == [{"name": "f", "arguments": '{"a":1}'}, {"name": "g", "arguments": ""}]
    assert got[4].content == "said on" and json.loads(got[4].tool_calls) == [{"id": "c", "type": "t", "function": {"name": "h", "arguments": "{}!"}}]
