"""Memories as Markdown files with YAML front matter, one file a memory, in folders by store and domain."""

from __future__ import annotations

import datetime
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.text import safe_name

STORES = ("permanent", "dynamic", "feel", "archive")
SCHEMA = (
    "path string, store string, id string, name string, tags array<string>, domain array<string>, content string, valence double, arousal double, model_valence double, importance int, activation_count double, "
    "type string, pinned boolean, protected boolean, resolved boolean, digested boolean, created string, last_active string, extra map<string,string>, error string"
)
_FRONT = re.compile(r"\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\Z)(.*)\Z", re.DOTALL)


def parse(path: str, raw: bytes) -> dict:
    """One file as a row; ``error`` tells why it couldn't be read, and such a row has no id."""
    import yaml

    row = {c.split(" ")[0]: None for c in re.split(r", (?=\w+ )", SCHEMA)} | {"path": path}
    try:
        found = _FRONT.match(raw.decode("utf-8"))
        if not found:
            raise ValueError("no front matter")
        meta = yaml.safe_load(found[1]) or {}
        number = lambda k: float(meta[k]) if isinstance(meta.get(k), (int, float)) and not isinstance(meta.get(k), bool) else None
        moment = lambda k: meta[k].isoformat(timespec="seconds") if isinstance(meta.get(k), datetime.datetime) else (None if meta.get(k) is None else str(meta[k]))
        row |= {k: number(k) for k in ("valence", "arousal", "model_valence", "activation_count")} | {k: bool(meta.get(k, False)) for k in ("pinned", "protected", "resolved", "digested")}
        row |= {k: [str(x) for x in meta.get(k) or []] for k in ("tags", "domain")} | {k: moment(k) for k in ("created", "last_active")}
        row |= {"id": str(meta.get("id") or path.rsplit("/", 1)[-1].removesuffix(".md")), "content": found[2].strip("\n"), "type": meta.get("type")}
        row |= {"name": str(meta["name"]) if meta.get("name") else row["id"], "importance": int(number("importance")) if number("importance") is not None else None}
        row["extra"] = {k: str(v) for k, v in meta.items() if k not in row}
    except Exception as e:  # noqa: BLE001
        row["error"] = f"{type(e).__name__}: {e}"[:200]
    return row


def read_markdown(spark: SparkSession, folder: str, include_archive: bool = False) -> DataFrame:
    """All memories below ``folder``; the archive is left out at the listing unless asked for. Unreadable files keep their ``error``."""
    stores = [s for s in STORES if include_archive or s != "archive"]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    store = F.regexp_extract("path", f"/({'|'.join(STORES)})/[^\\n]*$", 1)
    chosen = files.select("path", "content", store.alias("store")).where(F.col("store").isin(*stores))

    def run(frames):
        for frame in frames:
            rows = [parse(p, bytes(c)) | {"store": s} for p, c, s in zip(frame.path, frame.content, frame.store, strict=True)]
            yield pd.DataFrame(rows)[[c.split(" ")[0] for c in re.split(r", (?=\w+ )", SCHEMA)]]

    return chosen.mapInPandas(run, SCHEMA)


def folder_stats(spark: SparkSession, folder: str) -> DataFrame:
    """(store, n, kb) from the listing alone; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder).select("path", "length")
    return files.groupBy(F.regexp_extract("path", f"/({'|'.join(STORES)})/[^\\n]*$", 1).alias("store")).agg(F.count("*").alias("n"), F.round(F.sum("length") / F.lit(1024.0), 2).alias("kb"))


def as_markdown(memory: DataFrame) -> DataFrame:
    """(path, text) of each memory; the path is store/domain/name_id.md."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.to_json(F.array(x))), ", "), F.lit("]"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c.cast("string"))), r"(?s)^\[(.*)\]$", 1)
    flat = lambda c: F.regexp_replace(listed(c), r"\[(\"(?:[^\"\\]|\\.)*\")\]", "$1")
    fields = [("id", quoted), ("name", quoted), ("tags", flat), ("domain", flat), ("valence", None), ("arousal", None), ("importance", None), ("activation_count", None), ("type", None), ("pinned", None), ("protected", None), ("resolved", None), ("digested", None)]
    lines = [F.concat(F.lit(f"{c}: "), f(F.col(c)) if f else F.col(c).cast("string")) for c, f in fields if c in memory.columns]
    lines += [F.concat(F.lit(f"{c}: "), quoted(F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss"))) for c in ("created", "last_active") if c in memory.columns]
    front = F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))
    first = F.coalesce(F.get("domain", F.lit(0)), F.lit("未分类"))
    return memory.select(F.concat("store", F.lit("/"), safe_name(first), F.lit("/"), safe_name(F.col("name")), F.lit("_"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.concat(front, F.coalesce("content", F.lit(""))).alias("text"))


def write_markdown(memory: DataFrame, folder: str) -> None:
    """Each memory as a file below ``folder``, a URI that all executors reach. A file appears whole or not at all."""

    def run(rows):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        for row in rows:
            if ".." in row.path.split("/") or row.path.startswith("/"):
                raise ValueError(f"path leaves the folder: {row.path}")
            target = f"{base}/{row.path}"
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(f"{target}.part") as out:
                out.write(row.text.encode())
            system.move(f"{target}.part", target)

    as_markdown(memory).foreachPartition(run)


def front_fields(files: DataFrame) -> DataFrame:
    """(path, id, name, domain) by patterns only, for files (path, text) whose YAML can't be trusted; a domain list in one line isn't read."""
    front = F.regexp_extract("text", r"(?s)\A---[ \t]*\n(.*?)\n---", 1)
    one = lambda k: F.regexp_replace(F.trim(F.regexp_extract(front, rf"(?m)^{k}:[ \t]*(.*)$", 1)), "^[\"']|[\"']$", "")
    block = F.regexp_extract(front, r"(?m)^domain:[ \t]*\n((?:[ \t]*-[ \t]*.+\n?)+)", 1)
    listed = F.transform(F.filter(F.split(block, "\n"), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(x, "^[ \t]*-[ \t]*|[ \t]+$", ""))
    return files.select("path", one("id").alias("id"), one("name").alias("name"), F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("未分类"))).alias("domain"))


def write_table(memory: DataFrame, path: str) -> None:
    """The steady form: Parquet in partitions by store and first domain (``home``), so that a store or a domain that isn't asked for is never listed.

    Rows of a partition are brought together, and a large one is split again into several files.
    """
    home = safe_name(F.coalesce(F.get("domain", F.lit(0)), F.lit("未分类")))
    memory.withColumn("home", home).hint("rebalance", "store", "home").write.partitionBy("store", "home").mode("overwrite").parquet(path)
