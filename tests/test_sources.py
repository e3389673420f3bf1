import json

import pytest
from pyspark.sql import functions as F

from tidepool.sources import exports, markdown, providers
from tidepool.sources.memory import memories

DATA = "/root/testdata/sf0.001"


def turns(spark, *texts):
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "id string, text string")
    return [(r.id, r.role, r.content, r.timestamp) for r in exports.turns_of(files).orderBy("id", "turn").collect()]


def test_message_lists(spark):
    a = {"chat_messages": [{"sender": "human", "text": " hi ", "created_at": "t1"}, {"sender": "assistant", "content": [{"type": "text", "text": "a"}, {"text": "b"}]}, {"text": "  "}, "x"]}
    b = [{"messages": [{"role": "user", "content": "one"}]}, {"messages": [{"content": "two", "timestamp": "t2"}]}]
    assert turns(spark, json.dumps(a), json.dumps(b)) == [("f0", "human", "hi", "t1"), ("f0", "assistant", "a b", ""), ("f1", "user", "one", ""), ("f1", "user", "two", "t2")]


def test_trees(spark):
    node = lambda t, role, *parts: {"message": {"create_time": t, "author": {"role": role}, "content": {"parts": list(parts)}}}
    tree = {"mapping": {"b": node(20, "assistant", "late", "r"), "a": node(10, "user", "early"), "root": {"message": None}, "e": node(None, "user", " ")}}
    assert turns(spark, json.dumps(tree)) == [("f0", "user", "early", "1970-01-01T00:00:10"), ("f0", "assistant", "late r", "1970-01-01T00:00:20")]


def test_plain_logs(spark):
    log = "intro\nHuman: hello\nmore\n\nAI: yes: no\nDeepSeek:\n我: 好\n你：wide colon"
    assert [t[1:3] for t in turns(spark, log)] == [("user", "intro"), ("user", "hello\nmore"), ("assistant", "yes: no"), ("user", "好\n你：wide colon")]
    assert turns(spark, "{broken") == [("f0", "user", "{broken", "")]


def test_markdown_round_trip(spark, tmp_path):
    folder = f"{tmp_path}/store"
    m = memories(spark, DATA)
    markdown.write_markdown(m, f"file://{folder}")
    back = markdown.read_markdown(spark, folder, include_archive=True)
    assert back.where("error IS NOT NULL").count() == 0
    both = back.alias("b").join(m.alias("m"), F.col("b.id") == F.col("m.id").cast("string"))
    differ = [F.count_if(~F.col(f"b.{c}").eqNullSafe(F.col(f"m.{c}"))).alias(c) for c in ("name", "tags", "domain", "valence", "arousal", "importance", "activation_count", "type", "store", "pinned", "resolved", "digested")]
    got = both.agg(F.count("*").alias("n"), *differ).collect()[0].asDict()
    assert got.pop("n") == m.count() and not any(got.values())
    assert both.where(F.trim("b.content", F.lit("\n")) != F.trim("m.content", F.lit("\n"))).count() == 0
    assert markdown.read_markdown(spark, folder).count() == m.where("store <> 'archive'").count()
    assert {r.store: r.n for r in markdown.folder_stats(spark, folder).collect()} == {r.store: r["count"] for r in m.groupBy("store").count().collect()}


def test_markdown_edge_rows():
    row = markdown.parse("d/dynamic/x_1.md", "---\nname: 猫\nimportance: '7'\narousal: high\ncreated: 2024-01-02T03:04:05\nodd: [1]\n---\nbody\n---\nmore".encode())
    assert (row["id"], row["name"], row["importance"], row["arousal"], row["created"], row["content"], row["extra"]) == ("x_1", "猫", None, None, "2024-01-02T03:04:05", "body\n---\nmore", {"odd": "[1]"})
    assert markdown.parse("x.md", b"no front")["error"] and markdown.parse("x.md", b"---\n: [\n---\n")["error"] and markdown.parse("x.md", b"\xff")["error"]


class Moody:
    def complete(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [t.upper() for t in texts]


def test_providers(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bad b"), (3, None), (4, "a"), (5, "known")], "id long, text string")
    got = {r.id: (r.answer, r.error) for r in providers.answered(rows, Moody, "tag").collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError: no"), 3: ("", None), 4: ("A", None), 5: ("KNOWN", None)}
    cache = spark.createDataFrame([("known",)], "t string").select(F.sha2("t", 256).alias("content_hash"), F.lit("kept").alias("answer"))
    out, new = providers.memoised(rows, cache, Moody, "tag")
    assert {r.id: r.answer for r in out.collect()} == {1: "A", 2: None, 3: "", 4: "A", 5: "kept"} and new.count() == 2
    v = providers.hashed_vector("some words and words")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and providers.hashed_vector("") == [0.0] * 64


def test_settings_by_precedence():
    from tidepool.config import load_settings

    text = "decay: {rate: 0.2, archive_below: 0.5}\nrecall:\n  top_k: 7\n"
    got = load_settings(text, {"TIDEPOOL_DECAY__RATE": "0.3", "TIDEPOOL_RECALL__MAX_CARDS": " ", "OTHER": "x"}, {"recall": {"top_k": 9}})
    assert (got.decay.rate, got.decay.archive_below, got.recall.top_k, got.recall.max_cards, got.search.topic) == (0.3, 0.5, 9, 2, 4.0)
    assert load_settings(None, {}) == load_settings("", {})
    for bad in ("[1]", "decay: {unknown: 1}"):
        with pytest.raises((ValueError, TypeError)):
            load_settings(bad, {})


def test_table_by_store_and_domain(spark, tmp_path):
    from tidepool.sources.markdown import write_table
    from tidepool.sources.memory import memories

    m = memories(spark, "/root/testdata/sf0.001").withColumn("domain", F.when(F.col("id") % 5 != 0, F.col("domain")))
    write_table(m, f"{tmp_path}/t")
    back = spark.read.parquet(f"{tmp_path}/t")
    assert back.count() == m.count() and {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()} == {f"store={r.store}" for r in m.select("store").distinct().collect()}
    assert back.where("(home = '未分类') <> (id % 5 = 0)").isEmpty()


def test_backfill_outcomes(spark):
    from tidepool.sources import providers

    class Partly:
        def complete(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return ["[1.0, 2.0]" if "odd" not in t else "none" for t in texts]

    m = spark.createDataFrame([(1, "a"), (2, " \n"), (3, None), (4, "bad"), (5, "odd"), (6, "b")], "id long, content string")
    rows = providers.backfilled(m, spark.createDataFrame([(6,)], "id long"), Partly)
    assert {r.id: (r.embedding, r.outcome) for r in rows.collect()} == {1: ([1.0, 2.0], "success"), 2: (None, "skipped"), 3: (None, "skipped"), 4: (None, "failed"), 5: (None, "failed")}
    assert tuple(providers.backfill_counts(rows).collect()[0]) == (1, 2, 2)


def test_retagging(spark):
    from tidepool.functions import answers

    raw = ['```json\n{"domain": ["a", "b", "c", "d"], "tags": ["1", "2", "3", "4", "5", "6"], "suggested_name": " x/y: ", "valence": 3, "arousal": "0.4"}\n```', "{}", "[]", "broken", '{"valence": "much"}', None]
    got = [r.t for r in spark.createDataFrame(list(enumerate(raw)), "i int, raw string").select("i", answers.retagging(F.col("raw"), F.lit("old")).alias("t")).orderBy("i").collect()]
    assert tuple(got[0]) == (["a", "b", "c"], ["1", "2", "3", "4", "5"], "xy", 1.0, 0.4)
    assert tuple(got[1]) == (["未分类"], [], "old", 0.5, 0.3) and got[2:] == [None] * 4
