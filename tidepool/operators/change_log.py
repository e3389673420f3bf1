"""Writes as changed rows: a base table and a log of what changed since, merged on read.

``folder/base/version=N`` is a whole table, ``folder/changes/version=N`` holds the rows that write N changed and the ids
it removed. A write costs what it changes, not the table; reading lays the newest change of each id over the newest
base; ``compact`` makes that a base of its own. A version is there once its ``_SUCCESS`` is, so a write that was
cut short is not seen, and doing it again takes its place. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.operators.writes import touch_waves, with_waves

REMOVED, VERSION = "_removed", "_version"


def touch_changes(memory: DataFrame, activations: DataFrame, now: Column, spread: float = 0.3) -> DataFrame:
    """The rows that ``writes.touched`` changes, as it leaves them, and no others."""
    return with_waves(memory, touch_waves(memory, activations), "inner", now, spread)


def changes_between(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """What turns ``before`` into ``after``: new and changed rows, and with ``_removed`` the ids that are gone. Ids are unique."""
    columns = [c for c in before.columns if c != key]
    old = before.select(F.col(key).alias("_key"), F.struct(*columns).alias("_old"))
    both = old.join(after.select(key, F.struct(*columns).alias("_new")), F.col("_key") == F.col(key), "full")
    gone = F.col("_new").isNull()
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(F.coalesce(key, "_key").alias(key), *[F.col(f"_new.{c}").alias(c) for c in columns], gone.alias(REMOVED)).select(*before.columns, REMOVED)


def laid_over(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``base`` with the newest of ``changes`` (its columns, ``_removed``, ``_version``) of each id in place of its own row.

    Only changes are brought together by id; of the base nothing moves where their ids are few enough to be sent to it,
    which the planner judges by size.
    """
    newest = Window.partitionBy(key).orderBy(F.desc(VERSION))
    last = changes.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1")
    kept = base.join(changes.select(key).distinct(), key, "left_anti")
    return kept.select(*base.columns).unionByName(last.where(~F.col(REMOVED)).select(*base.columns))


def versions(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Versions of ``kind`` (base or changes) that were written to their end."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}/version=*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().removeprefix("version=")) for f in found)


def create(table: DataFrame, folder: str) -> None:
    """The first base: version 0."""
    table.write.mode("overwrite").parquet(f"{folder}/base/version=0")


def append(changes: DataFrame, folder: str, version: int | None = None) -> int:
    """Write ``changes`` as the next version, or again as the given one. Without ``_removed`` none are removed."""
    spark = changes.sparkSession
    known = max([*versions(spark, folder, "base"), *versions(spark, folder, "changes")])
    version = known + 1 if version is None else version
    if version <= max(versions(spark, folder, "base")):
        raise ValueError(f"version {version} is part of a base already")
    rows = changes if REMOVED in changes.columns else changes.withColumn(REMOVED, F.lit(False))
    rows.write.mode("overwrite").parquet(f"{folder}/changes/version={version}")
    return version


def snapshot(spark: SparkSession, folder: str, key: str = "id", version: int | None = None) -> DataFrame:
    """The table after write ``version``, or after the last one."""
    until = float("inf") if version is None else version
    begin = max((v for v in versions(spark, folder, "base") if v <= until), default=None)
    if begin is None:
        raise ValueError(f"{folder} has no base that is old enough")
    base = spark.read.parquet(f"{folder}/base/version={begin}")
    later = [v for v in versions(spark, folder, "changes") if begin < v <= until]
    if not later:
        return base
    # One read of all versions: each row knows its own by the folder it comes from.
    log = spark.read.option("basePath", f"{folder}/changes").parquet(*[f"{folder}/changes/version={v}" for v in later])
    return laid_over(base, log.withColumnRenamed("version", VERSION), key)


def compact(spark: SparkSession, folder: str, key: str = "id") -> int:
    """The table after the last write as a base of its own. Older versions stay readable until their folders are removed."""
    last = max([*versions(spark, folder, "base"), *versions(spark, folder, "changes")])
    if last not in versions(spark, folder, "base"):
        snapshot(spark, folder, key).write.mode("overwrite").parquet(f"{folder}/base/version={last}")
    return last
