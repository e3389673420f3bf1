"""Chat exports as turns: two JSON shapes, and plain text with role prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.answers import get, kind_of, parsed
from tidepool.operators.turns import plain_turns

_BLANK = r"(?U)^\s+|\s+$"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of whole files; the path is the id."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("text"))


def _conversations(v: Column) -> Column:
    return F.when(kind_of(v) == "ARRAY", get(v, "$", "array<variant>")).when(kind_of(v) == "OBJECT", F.array(v))


def _first(v: Column, *paths: str) -> Column:
    return F.coalesce(*[get(v, p) for p in paths])


def _joined(v: Column, path: str) -> Column:
    """Texts of a list of parts, each a string or an object with a text."""
    parts = F.transform(get(v, path, "array<variant>"), lambda p: F.when(kind_of(p) == "OBJECT", get(p, "$.text")).otherwise(get(p, "$")))
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), " ")


def message_list_turns(files: DataFrame) -> DataFrame:
    """(id, turn, role, content, timestamp) of exports whose conversations hold a list of messages (id, v)."""
    listed = F.coalesce(get(F.col("c"), "$.chat_messages", "array<variant>"), get(F.col("c"), "$.messages", "array<variant>"))
    rows = files.select("id", F.posexplode(_conversations(F.col("v"))).alias("conv", "c")).select("id", "conv", F.posexplode(listed).alias("pos", "m"))
    m = F.col("m")
    content = F.when(kind_of(F.try_variant_get(m, "$.content", "variant")) == "ARRAY", _joined(m, "$.content"))
    text = F.regexp_replace(F.coalesce(get(m, "$.text"), content, get(m, "$.content")), _BLANK, "")
    out = rows.where(kind_of(m) == "OBJECT").select("id", "conv", "pos", F.coalesce(_first(m, "$.sender", "$.role"), F.lit("user")).alias("role"), text.alias("content"), F.coalesce(_first(m, "$.created_at", "$.timestamp"), F.lit("")).alias("timestamp"))
    return _numbered(out)


def tree_turns(files: DataFrame) -> DataFrame:
    """The same of exports whose conversations hold a tree of nodes, in order of their time; nodes without a message are skipped."""
    nodes = F.map_values(get(F.col("c"), "$.mapping", "map<string, variant>"))
    rows = files.select("id", F.posexplode(_conversations(F.col("v"))).alias("conv", "c")).select("id", "conv", F.posexplode(nodes).alias("pos", "n"))
    m = F.try_variant_get(F.col("n"), "$.message", "variant")
    time = get(m, "$.create_time", "double")
    out = rows.where(kind_of(m) == "OBJECT").select(
        "id", "conv", F.struct(F.coalesce(time, F.lit(0.0)).alias("at"), "pos").alias("pos"), F.coalesce(get(m, "$.author.role"), F.lit("user")).alias("role"),
        F.regexp_replace(_joined(m, "$.content.parts"), _BLANK, "").alias("content"), F.coalesce(F.date_format(F.timestamp_seconds(time), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("timestamp"),
    )
    return _numbered(out)


def _numbered(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    kept = rows.where("content <> ''")
    return kept.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("conv", "pos")) - 1).alias("turn"), "role", "content", "timestamp")


def turns_of(files: DataFrame) -> DataFrame:
    """(id, turn, role, content, timestamp) of files (id, text) of any of the shapes; what isn't JSON is plain text."""
    v = files.withColumn("v", F.when(F.col("text").rlike(r"^\s*[\[{]"), parsed(F.col("text"))))
    first = F.try_element_at(_conversations(F.col("v")), F.lit(1))
    shape = F.when(F.col("v").isNull(), "plain").when(F.try_variant_get(first, "$.mapping", "variant").isNotNull(), "tree").otherwise("list")
    v = v.withColumn("shape", shape)
    plain = plain_turns(v.where("shape = 'plain'").select("id", "text")).withColumn("timestamp", F.lit(""))
    return message_list_turns(v.where("shape = 'list'")).unionByName(tree_turns(v.where("shape = 'tree'"))).unionByName(plain)
