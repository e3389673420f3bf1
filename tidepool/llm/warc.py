"""Web archives: pages written as WARC records, one gzip member each, and archives read back record by record.

Writing. Of pages with equal payloads the one with the smallest id becomes a ``response``; the others become ``revisit``
records, which hold the head of the answer only and name the response. Which is which is settled on ids and digests
alone; payloads are shuffled once, and only where a page may be a response. Spark's own text writer puts the members
into files, so that archives reach every store that Spark can write to, and a lost task leaves nothing half done.

Reading. A file is walked from its start: each member is inflated in small steps until it ends, the record is cut by its
Content-Length, and both of its digests are computed anew. A member that is broken becomes a row whose ``fault`` says
why, and reading goes on at the next member.

Null payloads count as empty ones. Ids that are null come after all others. Equal ids with equal payloads are told apart
by url; rows that are equal in all three are one response and revisits of it. Other columns are not kept. No pages give
a folder without records. A payload is held whole by a task, several times while it is compressed, and so is an archive
while it is read; an archive holds what one task wrote, about spark.sql.adaptive.advisoryPartitionSizeInBytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.runtime import prepare, stored

LEVEL = 6
#: Revisits that one row of the plan stands for at most, before they are dealt out.
COPIES = 5000
#: Compressed bytes that are inflated at a time: from the first to the second, doubled each time.
STEPS = 1 << 12, 1 << 20
DATE = "2024-01-31T00:00:00Z"
RECORD = "archive string, offset long, record_type string, record_id string, target_uri string, page_id string, refers_to_id string, refers_to string, payload_digest string, payload_bytes long, payload binary, fault string"


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(name: str, value: str | None) -> str:
    """A header line; control characters in the value are escaped, so that it stays one line."""
    return "" if value is None else f"{name}: " + re.sub(r"[\x00-\x1f\x7f]", lambda c: f"%{ord(c[0]):02X}", value) + "\r\n"


def _id_line(name: str, value: str | None) -> str:
    return _line(name, value and value.replace("%", "%25"))


def record_id(key: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{key}/{copy}'.encode()).digest()[:16], version=5)}>"


def member(kind: str, lines: str, block: bytes) -> bytes:
    """One record as one gzip member."""
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\n{lines}WARC-Block-Digest: sha1:{digest_of(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    return zlib.compress(head.encode() + block + b"\r\n\r\n", LEVEL, wbits=31)


def page_member(row: dict) -> bytes:
    """The record of a row with key, copy, page_id, url, html, digest, n_bytes, first_key, first_id, first_url; a revisit has no html."""
    revisit = row["html"] is None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    lines = _line("WARC-Record-ID", record_id(row["key"], row["copy"])) + _line("WARC-Date", DATE) + _line("WARC-Target-URI", row["url"])
    lines += _line("WARC-Payload-Digest", "sha1:" + digest) + "Content-Type: application/http; msgtype=response\r\n" + _id_line("X-Page-Id", row["page_id"])
    if revisit:
        lines += "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n" + _line("WARC-Refers-To", record_id(row["first_key"], 0))
        lines += _line("WARC-Refers-To-Target-URI", row["first_url"]) + _line("WARC-Refers-To-Date", DATE) + _id_line("X-Refers-To-Page-Id", row["first_id"])
    return member("revisit" if revisit else "response", lines, head if revisit else head + row["html"].encode())


def _strings(values: list[bytes]) -> pa.Array:
    """Bytes as a column of strings that aren't checked for UTF-8: the text writer writes them as they are."""
    raw = pa.array(values, pa.binary())
    return pa.Array.from_buffers(pa.string(), len(raw), raw.buffers())


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # The writer ends each row with the byte that every member ends with: the top byte of a size under 16 MB.
    # A larger record is followed by an empty member, which says nothing and ends so.
    closing = zlib.compress(b"", LEVEL, wbits=31)
    rest = lambda x: x[:-1] if x[-1] == 0 else x + closing[:-1]
    about = member("warcinfo", _line("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>") + _line("WARC-Date", DATE) + "Content-Type: application/warc-fields\r\n", b"format: WARC File Format 1.1\r\n")
    out: list[bytes] = [rest(about)]
    for batch in batches:
        size = 0
        for i in range(batch.num_rows):
            out.append(rest(page_member(batch.slice(i, 1).to_pylist()[0])))
            size += len(out[-1])
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([_strings(out)], ["value"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([_strings(out)], ["value"])
            out = []


def page_records(pages: DataFrame) -> DataFrame:
    """The rows that ``page_member`` writes, of ``pages`` (page_id, url, html)."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").alias("id"), F.col("page_id").cast("string").alias("page_id"), "url", body.alias("html"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))
    rows = rows.withColumn("key", F.sha1(F.to_json(F.struct("page_id", "url", "digest")).cast("binary")))
    known = stored(rows.groupBy("key", "id", "page_id", "url", "digest", "n_bytes").agg(F.count("*").alias("copies")))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("url").isNull().alias("no_url"), "url", "page_id", "key")).alias("first")
    firsts = stored(known.groupBy("digest").agg(first, F.sum("copies").alias("all_copies")).select("digest", F.col("first.key").alias("first_key"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), "all_copies"))
    columns = ["key", "copy", "page_id", "url", "html", "digest", "n_bytes", "first_key", "first_id", "first_url"]

    none = F.lit(None).cast("string")
    responses = rows.dropDuplicates(["key"]).join(firsts.select(F.col("first_key").alias("key")), "key", "left_semi")
    responses = responses.withColumns({"copy": F.lit(0).cast("long"), "first_key": none, "first_id": none, "first_url": none}).select(*columns)

    others = known.join(firsts.where("all_copies > 1").drop("all_copies"), "digest")
    begin = F.when(F.col("key") == F.col("first_key"), 1).otherwise(0).cast("long")
    blocks = others.withColumn("low", begin).where(F.col("low") < F.col("copies")).withColumn("from", F.explode(F.sequence("low", F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    dealt = blocks.repartition("key", "from").withColumn("copy", F.explode(F.sequence("from", F.least(F.col("copies"), F.col("from") + COPIES) - 1)))
    return responses.unionByName(dealt.withColumn("html", none).select(*columns))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id of any type, url, html) as compressed WARC files into the new folder ``path``."""
    prepare(pages.sparkSession)
    page_records(pages).mapInArrow(_members, "value string").write.option("lineSep", "\0").text(path)


def members(blob: memoryview) -> Iterator[tuple[int, bytes, str | None]]:
    """(offset, inflated bytes, fault) of the gzip members of a file, in order; after a broken one the next head is looked for."""
    at = 0
    while at < len(blob):
        start, step, parts, inflate = at, STEPS[0], [], zlib.decompressobj(31)
        try:
            while not inflate.eof and at < len(blob):
                parts.append(inflate.decompress(blob[at : at + step]))
                at, step = at + step, min(2 * step, STEPS[1])
            at = min(at, len(blob)) - len(inflate.unused_data)
            yield start, b"".join(parts), None if inflate.eof else "the member has no end"
        except zlib.error as e:
            yield start, b"", str(e)
            after = bytes(blob[start + 1 :]).find(b"\x1f\x8b\x08")
            at = start + 1 + after if after >= 0 else len(blob)


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse_record(raw: bytes) -> dict | None:
    """What a record says, with its payload; None of an empty member."""
    if not raw:
        return None
    row = dict.fromkeys(("record_type", "record_id", "target_uri", "page_id", "refers_to_id", "refers_to", "payload_digest", "payload_bytes", "payload", "fault"))
    head, found, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    length = fields.get("content-length", "")
    if not head.startswith(b"WARC/") or not found or not length.isdigit():
        return row | {"fault": "no record head"}
    back = lambda name: None if name not in fields else unquote(fields[name])
    block = rest[: int(length)]
    row |= {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "page_id": back("x-page-id"), "refers_to_id": fields.get("warc-refers-to"), "refers_to": back("x-refers-to-page-id")}
    row["payload_digest"] = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    if len(block) < int(length) or rest[int(length) :] != b"\r\n\r\n":
        return row | {"fault": "the block isn't as long as its Content-Length"}
    if "warc-block-digest" in fields and fields["warc-block-digest"].rpartition(":")[2] != digest_of(block):
        return row | {"fault": "the block's digest differs"}
    if row["record_type"] in ("response", "revisit"):
        answer, _, payload = block.partition(b"\r\n\r\n")
        said = _fields(answer).get("content-length", "")
        row["payload_bytes"] = int(said) if said.isdigit() else len(payload)
        if row["record_type"] == "response":
            row["payload"] = payload
            if row["payload_bytes"] != len(payload):
                return row | {"fault": "the payload isn't as long as its Content-Length"}
            if row["payload_digest"] not in (None, digest_of(payload)):
                return row | {"fault": "the payload's digest differs"}
    return row


def read_archives(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Every record of the compressed WARC files under ``path``, verified; with ``strict`` a fault ends the job.

    ``page_id`` and ``refers_to`` are what this module's writer says beside the standard's fields, null in other archives.
    """
    prepare(spark)
    names = [field.split()[0] for field in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[field.split()[1]]) for name, field in zip(names, RECORD.split(", "), strict=True)])

    def run(batches):
        for batch in batches:
            for where, content in zip(batch.column("path"), batch.column("content"), strict=True):
                blob, rows, size = memoryview(content.as_buffer() or b""), [], 0
                for offset, raw, fault in members(blob):
                    row = parse_record(raw) if not fault else dict.fromkeys(names) | {"fault": fault}
                    if row is None:
                        continue
                    if strict and row["fault"]:
                        raise ValueError(f"{where} at {offset}: {row['fault']}")
                    rows.append(row | {"archive": where.as_py(), "offset": offset})
                    size += len(raw)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)
