"""Legacy ARC archives, their conversion to WARC, and reading both back.

An ARC file is a sequence of records: a header line, whose fields depend on the version that
the file's first record declares, and as many bytes as the line says. The converter reads each
record by its declared length and makes of it what WARC wants: an identifier, an ISO time, a
record type, digests of block and payload. Of equal payloads one is stored; the others become
revisits that name it.

Archives are written by Spark's text writer, one record per row with the format's own
separator, gzipped, and read as binary files. So any store that Spark can reach will do; one
file is parsed by one task, and the writer keeps files near ``FILE_BYTES``.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyman.session import scratch_path, stage

#: Bytes of records in a file, before compression, about.
FILE_BYTES = 16 << 20
#: Smaller payloads are stored each on their own.
MIN_REVISIT_BYTES = 100
#: Name of the header that carries a page's id through an archive.
ID_HEADER = "X-Archive-Id"
#: Capture time of pages that come without one.
CAPTURED = "20240101000000"

# Field names of header lines by version, and the revisit profile of WARC 1.1.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- writing ARC ---------------------------------------------------------------------------


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes one ARC record per page; even files in version 1, odd ones in version 2.

    The record's content is an HTTP response. A null url is written as ``-``, white space in it
    as ``%20``; a null html is an empty payload; a null id leaves its header out.
    """
    body = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    ident = F.col(f"`{id_col}`").cast("string")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.coalesce(F.concat(F.lit(f"{ID_HEADER}: "), ident, F.lit("\r\n")), F.lit("")),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    url = F.regexp_replace(F.coalesce(F.col(f"`{url_col}`"), F.lit("-")), r"\s", "%20")
    rows = pages.select(url.alias("url"), F.concat(head, body).alias("content"), F.xxhash64(ident, body).alias("hash"))
    total = pages.agg(F.sum(F.octet_length(body).cast("long")).alias("n")).first()["n"] or 0
    files = max(1, -(-int(total) // FILE_BYTES))
    rows = rows.withColumn("file", F.pmod("hash", F.lit(files)).cast("int"))
    first = F.concat(F.col("url"), F.lit(f" 0.0.0.0 {CAPTURED} text/html "))
    length = F.octet_length("content").cast("string")
    line = F.when(F.col("file") % 2 == 0, F.concat(first, length)).otherwise(
        F.concat(first, F.lit("200 - - 0 pages.arc "), length)
    )
    records = rows.select("file", F.lit(1).alias("seq"), F.concat(line, F.lit("\n"), "content").alias("value"))
    opening = pages.sparkSession.range(files).select(
        F.col("id").cast("int").alias("file"), F.lit(0).alias("seq"), _opening(F.col("id") % 2 == 0).alias("value")
    )
    ordered = records.unionByName(opening).repartition(files, "file").sortWithinPartitions("file", "seq")
    ordered.select("value").write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _opening(first_version: Column) -> Column:
    """The record that opens a file and declares its version."""

    def text(version: int) -> str:
        content = f"{version} 0 Origin\n{ARC_FIELDS[version]}\n"
        middle = "" if version == 1 else "200 - - 0 pages.arc "
        return f"filedesc://pages.arc 0.0.0.0 {CAPTURED} text/plain {middle}{len(content)}\n{content}"

    return F.when(first_version, F.lit(text(1))).otherwise(F.lit(text(2)))


# --- parsing ---------------------------------------------------------------------------------


@dataclass
class ArcRecord:
    """A record of an ARC file: its fields by name, its content and its place in the file."""

    fields: dict[str, str]
    content: bytes
    offset: int

    @property
    def opens_file(self) -> bool:
        return self.fields["URL"].startswith("filedesc://")


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file. Fields are taken from the right: old URLs may hold spaces."""
    names, at = ARC_FIELDS[1].split(), 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line at byte {at} has no end")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if line.startswith("filedesc://"):
            # The version is on the first line of the record's content, whatever its own fields.
            version = data[end + 1 : data.find(b"\n", end + 1)].split(b" ")[0]
            names = ARC_FIELDS[2 if version == b"2" else 1].split()
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"header line at byte {at} has not the {len(names)} fields of its version")
        length = int(parts[-1])
        if end + 1 + length > len(data):
            raise ValueError(f"record at byte {at} is cut short")
        yield ArcRecord(dict(zip(names, parts, strict=True)), data[end + 1 : end + 1 + length], at)
        at = end + 1 + length


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each record of a WARC file."""
    at = 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        begin, length = end + 4, int(fields["Content-Length"])
        if begin + length > len(data):
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, data[begin : begin + length]
        at = begin + length


def split_http(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, head and payload of an HTTP response; without a head all is payload."""
    end = content.find(b"\r\n\r\n")
    if not content.startswith(b"HTTP/") or end < 0:
        return {}, b"", content
    lines = content[:end].decode("latin-1").split("\r\n")[1:]
    return dict(x.split(": ", 1) for x in lines if ": " in x), content[: end + 4], content[end + 4 :]


def iso_time(stamp: str) -> str:
    """An ARC date of 8 to 14 digits as WARC writes it."""
    s = (stamp + "00000000000000"[len(stamp) :])[:14]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:]}Z"


def unpacked(data: bytes) -> bytes:
    """Gzip members put together; other bytes as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


# --- conversion ------------------------------------------------------------------------------

_CONVERTED = (
    "record_id string, warc_type string, uri string, date string, ip string, "
    "key long, digest string, payload_bytes long, head binary, payload binary"
)


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _CONVERTED.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            path = batch.column("path")[i].as_py()
            for rows in _portions(_converted(path, unpacked(batch.column("content")[i].as_py()))):
                columns = dict(zip(names, zip(*rows, strict=True), strict=True))
                kinds = {"key": pa.int64(), "payload_bytes": pa.int64(), "head": pa.binary(), "payload": pa.binary()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[c], kinds.get(c, pa.string())) for c in names], names
                )


def _portions(rows: Iterator[tuple], size: int = 4 << 20) -> Iterator[list[tuple]]:
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += 200 + sum(len(x) for x in row if isinstance(x, bytes))
        if held_bytes >= size:
            yield held
            held, held_bytes = [], 0
    if held:
        yield held


def _converted(path: str, data: bytes) -> Iterator[tuple]:
    name = path.rsplit("/", 1)[-1]
    for record in parse_arc(data):
        if record.opens_file:
            continue
        f = record.fields
        headers, head, payload = split_http(record.content)
        digest = hashlib.sha256(payload).hexdigest()
        ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}:{record.offset}:{f['URL']}:{f['Archive-date']}:{digest}")
        key = headers.get(ID_HEADER)
        yield (
            f"<urn:uuid:{ident}>", "response" if head else "resource", f["URL"], iso_time(f["Archive-date"]),
            f["IP-address"], None if key is None else int(key), digest, len(payload), head, payload,
        )


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """A row per ARC record, with what its WARC record needs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(_convert, _CONVERTED)


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes the records of ARC files as WARC files.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes, that with the
    smallest key (then identifier; a null key comes last) stays as it is, and the others become
    revisits of it without the payload.
    """
    records = read_arc(spark, arc_path)
    order = F.struct(F.col("key").isNull().alias("none"), "key", "record_id")
    groups = (
        records.select("digest", "payload_bytes", "key", "record_id")
        .filter(F.col("payload_bytes") >= min_revisit_bytes)
        .groupBy("digest", "payload_bytes")
        .agg(F.min(order).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("digest").alias("d"), F.col("payload_bytes").alias("b"), F.col("first.record_id").alias("origin"))
    )
    small = stage(
        records.select("record_id", "digest", "payload_bytes")
        .join(stage(groups, "equal-payloads"), F.expr("digest = d AND payload_bytes = b AND record_id != origin"))
        .select(F.col("record_id").alias("id"), "origin"),
        "revisits",
    )
    told = records.join(small, F.col("record_id") == F.col("id"), "left")
    again = F.col("origin").isNotNull()
    block = F.when(again, F.col("head")).otherwise(F.concat("head", "payload"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    kind = F.when(F.col("warc_type") == "response", F.lit("application/http; msgtype=response")).otherwise(
        F.lit("application/octet-stream")
    )
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.col("warc_type"))),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", F.col("uri")),
        field("WARC-IP-Address", F.col("ip")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))),
        F.when(again, F.concat(field("WARC-Refers-To", F.col("origin")), field("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(F.lit("")),
        field("Content-Type", kind),
        field("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    whole = told.withColumn("block", block).select(F.concat(header.cast("binary"), "block").cast("string").alias("value"))
    # The text writer writes the bytes as they are, and the separator ends a WARC record.
    whole.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_path)


# --- reading WARC ----------------------------------------------------------------------------

_RECORDS = (
    "record_id string, record_type string, uri string, date string, key long, payload_bytes long, "
    "payload_digest string, refers_to string, payload binary"
)


def _read_warc(with_payload: bool):
    names = [c.split()[0] for c in _RECORDS.split(", ")]

    def rows_of(data: bytes) -> Iterator[tuple]:
        for fields, block in parse_warc(data):
            headers, _, payload = split_http(block)
            digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
            size = int(headers.get("Content-Length", 0)) if kind == "revisit" else len(payload)
            if kind != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload of {fields['WARC-Record-ID']} does not meet its digest")
            key = headers.get(ID_HEADER)
            yield (
                fields["WARC-Record-ID"], kind, fields["WARC-Target-URI"], fields["WARC-Date"],
                None if key is None else int(key), size, digest, fields.get("WARC-Refers-To"),
                payload if with_payload and kind != "revisit" else None,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"key": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        for batch in batches:
            for i in range(batch.num_rows):
                for rows in _portions(rows_of(unpacked(batch.column("content")[i].as_py()))):
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names
                    )

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per WARC record. Stored payloads are checked against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read_warc(with_payload), _RECORDS)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages through ARC and WARC files and back: a row per page.

    Columns: id, payload_bytes, payload_digest, record_type, refers_to. ``refers_to`` is the id
    of the record a revisit stands for. Equal rows are pages of their own: one is stored, the
    others revisit it. Null urls, ids and htmls are kept (see ``write_arc``); a null id is never
    the smallest. An empty table gives no rows; other columns are not archived.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, id_col, url_col, html_col)
    convert_arc(spark, arc, warc)
    records = stage(read_warc(spark, warc, with_payload=False).drop("payload"), "warc-records")
    revisited = records.filter("refers_to IS NOT NULL").select(F.col("refers_to").alias("id")).distinct()
    origins = records.join(revisited, F.col("record_id") == F.col("id"), "left_semi")
    origins = origins.select(F.col("record_id").alias("id"), F.col("key").alias("origin"))
    return records.join(origins, F.col("refers_to") == F.col("id"), "left").select(
        F.col("key").alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("origin").alias("refers_to")
    )
