"""Resumable import of chat exports: files in, chunks of turns out, each chunk once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepool.functions.text import content_hash
from tidepool.operators.turns import chunks
from tidepool.runtime import cut
from tidepool.sources.exports import turns_of


def file_chunks(files: DataFrame, target: int) -> DataFrame:
    """(source_hash, chunk_id, chunk, content, turn_count, tokens, timestamp_start, timestamp_end) of files (id, text). The chunk id only depends on the file's text and the chunk's place."""
    hashed = files.withColumn("source_hash", F.left(content_hash(F.col("text")), F.lit(16))).groupBy("source_hash").agg(F.first("text").alias("text"))
    turns = turns_of(hashed.select(F.col("source_hash").alias("id"), "text"))
    numbered = turns.select(F.xxhash64("id").alias("conv_id"), F.col("id").alias("source_hash"), F.col("turn").cast("long").alias("turn"), "role", F.col("content").alias("text"), "timestamp")
    made = chunks(numbered, target).join(numbered.select("conv_id", "source_hash").distinct(), "conv_id")
    return made.select("source_hash", F.sha2(F.concat_ws(":", "source_hash", F.col("chunk").cast("string")), 256).alias("chunk_id"), "chunk", "content", "turn_count", "tokens", "timestamp_start", "timestamp_end")


def run_import(spark: SparkSession, folder: str, out: str, checkpoint: str, target: int = 10_000) -> StreamingQuery:
    """Chunks of all files of ``folder`` that weren't imported yet, appended to ``out``; running it again goes on where it stopped.

    The checkpoint remembers files; chunks that a broken run had written already are left out by their id.
    """
    files = spark.readStream.format("text").option("wholetext", "true").load(folder).select(F.lit(None).cast("string").alias("id"), F.col("value").alias("text"))

    def batch(frame: DataFrame, _: int) -> None:
        new = file_chunks(frame, target)
        try:
            new = new.join(frame.sparkSession.read.parquet(out).select("chunk_id"), "chunk_id", "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(out)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(out: DataFrame) -> DataFrame:
    return out.groupBy("source_hash").agg(F.count("*").alias("chunks"), F.sum("turn_count").alias("turns"), F.sum("tokens").alias("tokens"))


def pending_chunks(planned: DataFrame, outcomes: DataFrame, paused: DataFrame) -> DataFrame:
    """The chunks still to do: those without an outcome, failed ones not among them, of sources (source_hash) that aren't paused."""
    return planned.join(outcomes.select("chunk_id"), "chunk_id", "left_anti").join(paused.select("source_hash"), "source_hash", "left_anti")


def _held(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, empty as long as nothing was written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


OUTCOME = "chunk_id string, api_calls int, created int, merged int, raw int, error string"


def process_pending(planned: DataFrame, outcomes: str, control: str, process: Callable[[DataFrame], DataFrame], step: int = 100, most_steps: int | None = None) -> int:
    """Process chunks of ``planned`` (source_hash, chunk_id, chunk, ...) that have no outcome yet, ``step`` at a time; how many steps it took.

    The table ``control`` (source_hash) of paused sources is read anew before each step, so a pause holds from the next step
    on, and lifting it lets a later call go on. ``process`` gives the rows of OUTCOME for its chunks. A step is one batch of
    the outcome log and is written as a whole: after a crash the unfinished step is done again under the same number, and
    no chunk gets a second outcome.
    """
    spark, done = planned.sparkSession, 0
    while most_steps is None or done < most_steps:
        log = _held(spark, outcomes, OUTCOME + ", batch long")
        todo = cut(pending_chunks(planned, log, _held(spark, control, "source_hash string")).orderBy("source_hash", "chunk", "chunk_id").limit(step))
        if todo.isEmpty():
            break
        number = (log.agg(F.max("batch")).collect()[0][0] or 0) + 1
        told = process(todo).select(*[c.split()[0] for c in OUTCOME.split(", ")]).dropDuplicates(["chunk_id"])
        told.write.mode("overwrite").parquet(f"{outcomes.rstrip('/')}/batch={number}")
        done += 1
    return done


def import_status(planned: DataFrame, outcomes: DataFrame, paused: DataFrame, most_errors: int = 100) -> DataFrame:
    """One row a source of ``planned`` (source_hash, chunk_id, chunk): what became of its chunks, and ``status``.

    ``outcomes`` (chunk_id, api_calls, created, merged, raw, error) has a row for each chunk that was processed, also for
    failed ones, whose first 200 characters of error are listed with the chunk's number, for the first ``most_errors`` of a
    source. An outcome written twice, after a restart, counts once. A source without outcomes is idle, or paused if it is
    in ``paused`` (source_hash); one with all its chunks is completed, whether paused or not.
    """
    once = outcomes.dropDuplicates(["chunk_id"]).withColumn("done", F.lit(1))
    met = planned.join(once, "chunk_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counted = met.groupBy("source_hash").agg(
        F.count("*").alias("total_chunks"), total("done").alias("processed"), total("api_calls").alias("api_calls"),
        total("created").alias("memories_created"), total("merged").alias("memories_merged"), total("raw").alias("memories_raw"),
    )
    # A bounded rank first, so that no source's list grows with its failures.
    failed = met.where(F.col("error").isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy("source_hash").orderBy("chunk", "chunk_id"))).where(F.col("place") <= most_errors)
    line = F.concat(F.lit("Chunk "), F.col("chunk").cast("string"), F.lit(": "), F.left("error", F.lit(200)))
    errors = failed.groupBy("source_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]).alias("errors"))
    held = paused.select("source_hash").distinct().withColumn("held", F.lit(True))
    status = F.when(F.col("processed") == F.col("total_chunks"), "completed").when(F.col("held"), "paused").when(F.col("processed") > 0, "running").otherwise("idle")
    return counted.join(errors, "source_hash", "left").join(held, "source_hash", "left").select(*counted.columns, F.coalesce("errors", F.array().cast("array<string>")).alias("errors"), status.alias("status"))
