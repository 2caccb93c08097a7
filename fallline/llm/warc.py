"""A content-addressed WARC archive.

An archive is a folder with two tables.  ``payloads`` holds every distinct payload once, under its
SHA-256; ``records`` holds the exact header bytes of every record (WARC header and, for HTTP records,
the HTTP header) and the address of its payload.  A join on the address gives back the original
records, and reading verifies each stored payload against its address.

Of the records with equal payloads of at least ``min_bytes`` bytes, that with the largest key is a
``response`` and the others are ``revisit`` records that name it; smaller payloads are all responses.

Defined results for odd input: a null payload is the empty payload; a null key is smaller than every
other key; a null address gets the target ``urn:key:<key>``; control characters in an address are
percent-encoded, so that no address can forge a header line; payloads of any length are kept whole; repeated rows give
records that differ in their identifiers alone, and all rows that carry the response's key are responses, of which
revisits name the first; an empty table gives an archive without
rows.  Columns of the input that are not named in the call are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fallline.llm.rows import per_partition

#: Bytes of a WARC file that are opened and parsed at a time.
PIECE = 16 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """The upper-case base32 form of SHA-1: each five hex digits are four base32 digits."""
    digest = F.sha1(data)
    out = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, 1) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def _uuid(*parts: Column) -> Column:
    """A name-based identifier of a record, the same whenever the record is written again."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def write_archive(pages: DataFrame, path: str, *, key: str = "page_id", target: str = "url", payload: str = "html",
                  min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` below ``path``."""
    spark = pages.sparkSession
    body = F.coalesce(pages[payload].cast("binary"), F.lit(b""))
    rows = pages.select(pages[key].alias("key"), pages[target].cast("string").alias("target"), body.alias("payload"))
    rows = rows.withColumn("address", F.sha2("payload", 256))

    # One row for each distinct payload: map-side aggregation leaves at most one row a partition of the
    # hottest payload before the shuffle.
    payloads = rows.groupBy("address").agg(F.max("key").alias("response_key"), F.first("payload").alias("payload"))
    payloads = payloads.select("address", "response_key", F.octet_length("payload").cast("long").alias("n_bytes"),
                               base32_sha1(F.col("payload")).alias("sha1"), "payload")
    payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")

    stored = spark.read.parquet(f"{path}/payloads").select("address", "response_key", "n_bytes", "sha1")
    # Equal rows are told apart by a number; the first of a key and payload is the one that others name.
    known = rows.select("key", "target", "address").withColumn("copy", F.row_number().over(Window.partitionBy("key", "address").orderBy("target"))).join(stored, "address")
    response = F.col("key").eqNullSafe(F.col("response_key")) | (F.col("n_bytes") < min_bytes)
    uri = F.coalesce("target", F.concat(F.lit("urn:key:"), F.coalesce(F.col("key").cast("string"), F.lit("null"))))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace(uri, "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1F\x7F]", "%20")
    record_id = _uuid(F.col("key"), F.col("address"), F.col("copy"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.length(http) + F.when(response, F.col("n_bytes")).otherwise(0)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(response, "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: <urn:uuid:"), record_id,
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(~response, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <urn:uuid:"), _uuid(F.col("response_key"), F.col("address"), F.lit(1)), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit("\r\n\r\n"),
    )
    records = known.select("key", "address", F.concat(head, http).cast("binary").alias("header"))
    records.write.option("compression", "zstd").parquet(f"{path}/records")


def header_field(header: Column, name: str) -> Column:
    """The value of a WARC header line, null where there is none."""
    value = F.regexp_extract(header.cast("string"), rf"(?m)^{name}: ?([^\r\n]*)\r?$", 1)
    return F.when(value != "", value)


def read_archive(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """The records of an archive: key, record_type, payload_bytes, payload_digest, refers_to, header and,
    if asked for, payload and the record's exact bytes.

    Every payload is hashed again, once, before the join; one that differs from its address ends the read.  ``refers_to`` is
    the key of the record that a revisit's header names.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("address")
    payloads = payloads.select(
        "address", base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        *(["payload"] if with_payload else []),
        F.when(sound, True).otherwise(F.raise_error(F.concat(F.lit("payload differs from its address "), F.col("address"))).cast("boolean")).alias("sound"),
    ).filter("sound").drop("sound")
    records = spark.read.parquet(f"{path}/records")
    records = records.withColumns({"record_type": header_field(F.col("header"), "WARC-Type"), "names": header_field(F.col("header"), "WARC-Refers-To")})
    named = records.filter("record_type = 'response'").select(header_field(F.col("header"), "WARC-Record-ID").alias("names"), F.col("key").alias("refers_to"))
    out = records.join(named, "names", "left").join(payloads, "address")
    columns = ["key", "record_type", "payload_bytes", "payload_digest", "refers_to", "header"]
    if not with_payload:
        return out.select(*columns)
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return out.select(*columns, "payload", F.concat(F.col("header"), block, F.lit(b"\r\n\r\n")).alias("record"))


def export_warc(spark: SparkSession, path: str, to: str, *, files: int | None = None) -> None:
    """Write an archive's records as ``.warc.gz`` files.  A record ends in a line feed, so Spark's text
    writer gives the exact bytes, with its commit protocol, on any file system."""
    record = F.col("record")
    lines = read_archive(spark, path).select(F.substring(record, F.lit(1), F.octet_length(record) - 1).cast("string").alias("value"))
    if files:
        lines = lines.repartition(files)
    lines.write.option("lineSep", "\n").option("compression", "gzip").text(to)


def parse_warc(data: bytes, *, cut: bool = False) -> Iterator[tuple[bytes, bytes, int]]:
    """(header, block, where the next record begins) of each record of an uncompressed WARC file, by Content-Length; with
    ``cut`` a last record that is not there in whole is left out."""
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        header = data[at : end + 4]
        length = next((int(line.split(b":", 1)[1]) for line in header.split(b"\r\n") if line.lower().startswith(b"content-length:")), 0)
        at = end + 4 + length
        if cut and len(data) < at + 4:
            return
        while data[at : at + 2] == b"\r\n":
            at += 2
        yield header, data[end + 4 : end + 4 + length], at


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (gzip or plain): record_type, target, header and block as stored."""
    def pieces(data: bytes) -> Iterator[bytes]:
        """The file's content, gzip members opened bit by bit."""
        while data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            while not member.eof and (data or member.unconsumed_tail):
                yield member.decompress(member.unconsumed_tail or data, PIECE)
                data = b""
            data = member.unused_data
        yield data

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                held, pairs = b"", []
                for piece in pieces(content.as_py()):
                    held += piece
                    whole = list(parse_warc(held, cut=True))
                    pairs += whole
                    if whole:
                        held = held[whole[-1][2] :]
                    if sum(len(b) for _, b, _ in pairs) > PIECE:
                        yield {"header": pa.array([a for a, _, _ in pairs], pa.binary()), "block": pa.array([b for _, b, _ in pairs], pa.binary())}
                        pairs = []
                pairs += parse_warc(held)
                yield {"header": pa.array([p[0] for p in pairs], pa.binary()), "block": pa.array([p[1] for p in pairs], pa.binary())}

    raw = per_partition(spark.read.format("binaryFile").load(path).select("content"), read, "header binary, block binary")
    return raw.select(header_field(F.col("header"), "WARC-Type").alias("record_type"), header_field(F.col("header"), "WARC-Target-URI").alias("target"), "header", "block")
