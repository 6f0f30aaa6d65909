"""Web archives: records, canonical URLs, and not-modified revisits resolved against earlier responses.

A revisit says that a server answered 304: its payload is that of an earlier
full response to the same URL.  ``resolve_revisits`` finds that response by an
as-of join on the canonical URL, checks that the validators agree, and merges
the headers that a 304 may update into the stored ones.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Header fields that a 304 response may update in a stored one, and query parameters that don't change a page.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"
#: Seconds of a time bucket: within one, events of a URL are put in order together; longer histories are carried by a row a bucket.
BUCKET_SECONDS = 6 * 3600
_STATUS = re.compile(r"HTTP/\S+\s+(\d{3})(?!\d)")


def canonical_url(url: Column) -> Column:
    """Lower-cased host without ``www.``, no scheme, default port, fragment, tracking parameters or closing slash; null stays null."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"#[\s\S]*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    rest = F.substring(bare, F.length(host) + 1, F.length(bare))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(rest, rf"([?&])(?:(?:{TRACKING})=[^&]*(?:&|$))+", "$1")
    return F.concat(host, F.regexp_replace(rest, r"/?[?&]?$", ""))


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """Each revisit of ``records`` with the response it stands for.

    ``records``: record_id long, type (``response`` or ``revisit``), url
    string, time long (seconds), headers map<string, string> of lower-case
    names.  The result has, for each revisit: record_id, url_key, time,
    refers_to (the record of the latest full response to the canonical URL
    strictly before it, the larger record_id of equal times), status and
    headers.  status: ``resolved``; ``mismatch`` where an etag, or without one
    in both a last-modified, differs; ``unchecked`` where no validator is in
    both; ``no_response``.  headers are the response's with the permitted ones
    of the revisit put over them, only where resolved, else the revisit's own.

    Optional columns: http_status int and truncated boolean, with which only
    whole responses of status 200 are full ones; profile and digest strings.
    A revisit of the identical-payload profile is a whole answer of its own but
    for the payload: it is judged by the digests, not by validators, and its
    headers stay as they are.

    Events meet by (URL, time bucket), and the last response of each bucket is
    carried to later ones by a row a bucket: a URL that a third of all
    records share is dealt over its buckets.  Records without a URL or a time
    resolve to ``no_response``.
    """
    given = lambda name, kind: F.col(name) if name in records.columns else F.lit(None).cast(kind)
    wanted = F.lit(True)
    if "http_status" in records.columns:
        wanted &= F.coalesce(F.col("http_status") == 200, F.lit(False))
    if "truncated" in records.columns:
        wanted &= ~F.coalesce("truncated", F.lit(False))
    events = records.where((F.col("type") == "revisit") | (F.col("type") == "response") & wanted)
    events = events.select("record_id", "type", "time", "headers", given("digest", "string").alias("digest"), given("profile", "string").alias("profile"), canonical_url(F.col("url")).alias("url_key"))
    events = events.withColumn("bucket", F.floor(F.col("time") / bucket_seconds))
    full = F.col("type") == "response"
    here = F.when(full & F.col("time").isNotNull() & F.col("url_key").isNotNull(), F.struct("time", "record_id", "headers", "digest"))
    # Headers are maps, which have no order: the latest is the one of the largest (time, record_id).
    latest = events.where(full & F.col("time").isNotNull() & F.col("url_key").isNotNull()).groupBy("url_key", "bucket").agg(F.max_by(F.struct("time", "record_id", "headers", "digest"), F.struct("time", "record_id")).alias("last"))
    spans = latest.select("url_key", "bucket", "last").unionByName(events.where(~full).select("url_key", "bucket").distinct(), allowMissingColumns=True)
    spans = spans.groupBy("url_key", "bucket").agg(F.max_by("last", F.struct(F.col("last").isNotNull())).alias("last"))
    earlier = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("url_key", "bucket", F.last("last", ignorenulls=True).over(earlier).alias("before")).where("before is not null")
    # Revisits before responses of the same second: a response must be strictly earlier.
    order = Window.partitionBy("url_key", "bucket").orderBy("time", full, "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("inside", F.last(here, ignorenulls=True).over(order)).where(~full)
    found = seen.join(carried, ["url_key", "bucket"], "left").withColumn("match", F.coalesce("inside", "before"))
    ours, theirs = F.col("headers"), F.col("match.headers")
    both = lambda name: F.element_at(ours, name).isNotNull() & F.element_at(theirs, name).isNotNull()
    same = lambda name: F.element_at(ours, name) == F.element_at(theirs, name)
    identical = F.coalesce(F.col("profile").contains("identical-payload"), F.lit(False))
    digests = F.col("digest") == F.col("match.digest")
    status = (
        F.when(F.col("match").isNull(), "no_response")
        .when(identical, F.when(digests.isNull(), "unchecked").when(digests, "resolved").otherwise("mismatch"))
        .when(both("etag"), F.when(same("etag"), "resolved").otherwise("mismatch"))
        .when(both("last-modified"), F.when(same("last-modified"), "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    updates = F.map_filter(ours, lambda k, _: k.isin(*permitted))
    kept = F.map_filter(theirs, lambda k, _: ~F.coalesce(F.map_contains_key(updates, k), F.lit(False)))
    merged = F.when((status == "resolved") & ~identical, F.map_concat(kept, updates)).otherwise(ours)
    return found.select("record_id", "url_key", "time", F.col("match.record_id").alias("refers_to"), status.alias("status"), merged.alias("headers"))


def format_record(kind: str, url: str, date: str, fields: dict[str, str], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    head = {"WARC-Type": kind, "WARC-Target-URI": url, "WARC-Date": date, **fields, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


class _Inflated(io.RawIOBase):
    """The bytes of gzip members, as far as they are whole: a cut or broken one ends the stream where it can't be read on."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held = memoryview(data), 0, b""
        self.member = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.held and (self.at < len(self.data) or self.member.unconsumed_tail):
            tail = self.member.unconsumed_tail
            part = tail or self.data[self.at : self.at + (1 << 16)]
            self.at += 0 if tail else len(part)
            try:
                self.held = self.member.decompress(part, 1 << 16)
            except zlib.error:
                self.at = len(self.data)
                self.member = zlib.decompressobj(31)
                break
            if self.member.eof:  # the next member starts in what is left over
                self.at -= len(self.member.unused_data)
                self.member = zlib.decompressobj(31)
        n = min(len(out), len(self.held))
        out[:n], self.held = self.held[:n], self.held[n:]
        return n


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-cased header fields, block) of the records of a WARC file, plain or gzipped, which is inflated as it is read; what follows a broken record is left out."""
    stream = io.BufferedReader(_Inflated(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            return
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = fields.get("content-length", "")
        if not size.isdigit():
            return
        yield fields, stream.read(int(size))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_type, url, date, fields, http_status, http_headers, profile, truncated, payload of every record of WARC files, one file a row of work (of 2 GB at most, as Spark reads whole files).

    http_status is null where the block is no HTTP message; profile is that of
    revisits; truncated records say so or end before their length, as where a file is cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                for fields, block in parse_records(value.as_py()):
                    head, mark, payload = block.partition(b"\r\n\r\n")
                    http = fields.get("content-type", "").startswith("application/http") and mark
                    lines = head.decode("utf-8", "replace").split("\r\n")[1:] if http else []
                    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                    said = _STATUS.match(head[:64].decode("utf-8", "replace")) if http else None
                    cut = "warc-truncated" in fields or len(block) < int(fields["content-length"])
                    row = (fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-date"), fields, int(said[1]) if said else None, headers, fields.get("warc-profile"), cut, payload if http else block)
                    kinds = (pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.bool_(), pa.binary())
                    values = [list(x.items()) if isinstance(x, dict) else x for x in row]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], names=["record_type", "url", "date", "fields", "http_status", "http_headers", "profile", "truncated", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "record_type string, url string, date string, fields map<string,string>, http_status int, http_headers map<string,string>, profile string, truncated boolean, payload binary")


def archive_records(read: DataFrame) -> DataFrame:
    """What ``read_warc`` gives as the input of ``resolve_revisits``; record_id is the archive's own, a string."""
    field = lambda name: F.element_at("fields", name)
    return read.where(F.col("record_type").isin("response", "revisit")).select(
        field("warc-record-id").alias("record_id"),
        F.col("record_type").alias("type"),
        F.regexp_replace("url", "^<|>$", "").alias("url"),
        F.try_to_timestamp("date").cast("long").alias("time"),
        F.col("http_headers").alias("headers"),
        "http_status",
        "truncated",
        "profile",
        F.lower(field("warc-payload-digest")).alias("digest"),
    )
