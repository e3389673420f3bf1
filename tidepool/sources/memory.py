"""The memory table, and the session tables, made from the test tables by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOW = "2024-01-31 00:00:00"

MEMORY = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("domain", T.ArrayType(T.StringType())), T.StructField("content", T.StringType()), T.StructField("valence", T.DoubleType()),
        T.StructField("arousal", T.DoubleType()), T.StructField("model_valence", T.DoubleType()), T.StructField("importance", T.IntegerType()),
        T.StructField("activation_count", T.DoubleType()), T.StructField("type", T.StringType()), T.StructField("store", T.StringType()),
        T.StructField("pinned", T.BooleanType()), T.StructField("protected", T.BooleanType()), T.StructField("resolved", T.BooleanType()),
        T.StructField("digested", T.BooleanType()), T.StructField("created", T.TimestampNTZType()), T.StructField("last_active", T.TimestampNTZType()),
    ]
)


def now_column(now: str = NOW):
    return F.lit(now).cast("timestamp_ntz")


def memories(spark: SparkSession, sf_dir: str, now: str = NOW, head: int | None = None) -> DataFrame:
    """The memory table over ``documents`` and ``labels``: every column follows from doc_id by fixed arithmetic.

    ``seq`` is the scan order, which ties fall back on. ``days`` are the days since ``last_active``. For plans that use no more of
    a content than its first ``head`` characters, only these are carried through the join with the labels.
    """
    text = F.col("text") if head is None else F.left("text", F.lit(head)).alias("text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text, "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    k = F.col("doc_id")
    age, lag = (F.lit(7) * k) % 2160, k % 48
    kind = F.when(k % 17 == 0, "permanent").when(k % 13 == 0, "feel").when(k % 29 == 0, "archived").otherwise("dynamic")
    moment = lambda hours: F.timestamp_add("HOUR", hours.cast("int"), now_column(now))
    return docs.join(labels, "doc_id", "left").select(
        k.alias("id"), F.concat(F.lit("doc "), k.cast("string")).alias("name"), F.array("lang", "source").alias("tags"), F.array("lang").alias("domain"), F.col("text").alias("content"),
        ((F.lit(37) * k) % 101 / F.lit(100.0)).alias("valence"), ((F.lit(53) * k) % 101 / F.lit(100.0)).alias("arousal"), F.lit(None).cast("double").alias("model_valence"),
        (F.lit(1) + k % 10).cast("int").alias("importance"), (F.lit(1) + k % 12 + F.lit(0.3).cast("double") * (k % 2)).cast("double").alias("activation_count"),
        kind.alias("type"), F.when(kind == "archived", "archive").otherwise(kind).alias("store"), (k % 23 == 0).alias("pinned"), (k % 97 == 0).alias("protected"),
        (F.coalesce("quality", F.lit(1)) == 0).alias("resolved"), (k % 7 == 0).alias("digested"),
        moment(-age).alias("created"), F.least(now_column(now), moment(lag - age)).alias("last_active"),
        (F.greatest(F.lit(0), age - lag) / F.lit(24.0)).alias("days"), (age / F.lit(24.0)).alias("age_days"), k.alias("seq"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding) with doubles; at most one row an id."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, round_id, bucket_id, completed_at): events as completed rounds, numbered in order of time within a session."""
    from pyspark.sql import Window

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "props")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("session_id"), F.row_number().over(order).cast("long").alias("round_id"), F.get_json_object("props", "$.k").cast("long").alias("bucket_id"), F.col("ts").cast("timestamp_ntz").alias("completed_at"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
