"""WARC archives: writing, reading, and revisit resolution.

Archives are written by Spark's text writer (record lines end in CRLF, so a row is a record without its last
line end) and so by its output committer: a task that is lost leaves no half archive. With ``compression``
gzip each archive is one gzip stream. The reader takes whole archives (plain, one gzip stream or one member
per record) and parses them by Content-Length; an archive that is written here has a bounded number of records.

Revisit resolution moves record headers only: they are shuffled by payload digest, the first response of each
digest is found by an aggregate, and joined back (a digest with many records is looked up by broadcast, see
`exact_dedup.HOT`). Payloads move once, to their decisions, when the new archives are written with fresh headers.

Null payloads are empty; empty payloads are equal to each other. Payloads shorter than ``least`` bytes are
all responses. Rows with a null id come last when a response is chosen; ``refers_to`` of its revisits is
then null. Rows that repeat an id are records of their own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.llm.common import shared_path, staged
from motefield.llm.exact_dedup import HOT

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("archive string, place long, record_type string, record_id string, page_id long, uri string, date string, "
          "digest string, payload_bytes long, refers_to long, payload binary")


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base32 (RFC 4648), upper case: each 5 hex digits are 4 base32 digits."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record as text, without the CRLF that the writer's line end supplies."""
    lines = [F.lit("WARC/1.1")]
    for name, value in headers:
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value.cast("string"))))
    head = F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), CRLF)
    length = F.octet_length(block).cast("string")
    return F.concat(head, F.lit(f"{CRLF}Content-Length: "), length, F.lit(CRLF + CRLF), block, F.lit(CRLF))


def _urn(page: Column, more: Column) -> Column:
    """A record id that a task which runs again repeats: the page's id, else a digest of what the row holds."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.concat(F.lit("none-"), more)), F.lit(">"))


def _clean(value: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(value, r"[\r\n]+", " ")


def _http(size: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF + CRLF))


def write_archives(rows: DataFrame, path: str, archive_records: int = 4000, compression: str = "gzip") -> None:
    """Writes records. ``rows``: ``page_id, uri, date, payload`` (text), and optionally ``record_type`` with
    ``refers_to, refers_uri, refers_date, payload_bytes, digest`` for revisits (their payload is not written).

    Each task writes its rows where they are, cut into archives of at most ``archive_records`` records."""
    payload = F.coalesce(F.col("payload"), F.lit(""))
    if "record_type" in rows.columns:
        kind, size, digest = F.col("record_type"), F.col("payload_bytes"), F.col("digest")
        refers, uri, date = F.col("refers_to"), F.col("refers_uri"), F.col("refers_date")
    else:
        kind, size, digest = F.lit("response"), F.octet_length(payload), base32_sha1(payload)
        refers = uri = date = F.lit(None).cast("string")
    revisit = kind == "revisit"
    block = F.concat(_http(size), F.when(revisit, F.lit("")).otherwise(payload))
    text = _record([
        ("WARC-Type", kind), ("WARC-Record-ID", _urn(F.col("page_id"), F.sha1(payload))), ("WARC-Date", F.coalesce("date", F.lit("1970-01-01T00:00:00Z"))),
        ("WARC-Target-URI", _clean(F.col("uri"))), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(revisit & refers.isNotNull(), F.concat(F.lit("<urn:page:"), refers.cast("string"), F.lit(">")))),
        ("WARC-Refers-To-Target-URI", F.when(revisit, _clean(uri))), ("WARC-Refers-To-Date", F.when(revisit, date)),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    ], block)
    writer = rows.select(text.alias("value")).write.option("lineSep", CRLF).option("maxRecordsPerFile", archive_records)
    writer.option("compression", compression).option("zlib.compress.level", "BEST_SPEED").text(path)


_PAGE = re.compile(rb"<urn:page:(-?\d+)>")


def _inflated(data: bytes) -> bytes:
    """The content of a plain or gzip archive, of one member or many."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out += [d.decompress(data), d.flush()]
        data = d.unused_data
    return b"".join(out) if out else data


def parse_archive(data: bytes):
    """(place, headers, block) of each record; header names are lower-cased."""
    at, end = 0, len(data)
    while at < end:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower()] = value.strip()
        body = stop + 4
        size = int(headers[b"content-length"])
        yield at, headers, data[body: body + size]
        at = body + size
        while data.startswith(b"\r\n", at):
            at += 2


def _id(value: bytes | None) -> int | None:
    m = _PAGE.fullmatch(value or b"")
    return int(m[1]) if m else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives below ``path``. The digest is that of the payload read (checked against the
    header's); of revisits, which have none, the header's."""

    def run(batches):
        names = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                out = []
                for place, h, block in parse_archive(_inflated(content)):
                    kind, named = h[b"warc-type"].decode(), h.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode()
                    http, _, body = block.partition(b"\r\n\r\n")
                    size = len(body)
                    if kind == "revisit":
                        size, digest = int(re.search(rb"content-length: *(\d+)", http.lower())[1]), named
                    else:
                        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                        if named and named != digest:
                            raise ValueError(f"{archive}, byte {place}: the payload is not what its digest says")
                    out.append((archive, place, kind, h[b"warc-record-id"].decode(), _id(h[b"warc-record-id"]), h.get(b"warc-target-uri", b"").decode() or None,
                                h.get(b"warc-date", b"").decode(), digest, size, _id(h.get(b"warc-refers-to")), body if payloads and kind != "revisit" else None))
                    if len(out) == 1000:
                        yield _batch(out, names)
                        out = []
                if out:
                    yield _batch(out, names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, RECORD)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def resolve(headers: DataFrame, least: int = 0) -> DataFrame:
    """Decides each record: ``archive, place, record_type, refers_to, refers_uri, refers_date``.

    The response of a digest is its record of the least page id among those with a payload. A revisit whose
    original is not among the records stays a revisit of what it named.
    """
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "place", "uri", "date")
    has = F.col("record_type") != "revisit"
    firsts = headers.groupBy("digest").agg(F.min(F.when(has, order)).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = staged(firsts.where("first is not null and n > 1"), "firsts")
    total = headers.agg(F.count(F.lit(1))).scalar()
    hot = F.broadcast(firsts.where(F.col("n") * HOT > total))  # fewer than HOT digests can pass
    hit = headers.join(hot, "digest", "left")
    rest = hit.where("first is null").drop("first", "n").join(firsts, "digest", "left")
    both = hit.where("first is not null").unionByName(rest)
    same = (F.col("archive") == F.col("first.archive")) & (F.col("place") == F.col("first.place"))
    again = F.coalesce(~same & (F.col("payload_bytes") >= least), F.lit(False))
    return both.select(
        "archive", "place", F.when(again | ~has, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first.page_id")).when(~has, F.col("refers_to")).alias("refers_to"),
        F.when(again, F.col("first.uri")).alias("refers_uri"), F.when(again, F.col("first.date")).alias("refers_date"))


def deduplicate(spark: SparkSession, source: str, target: str, least: int = 0, archive_records: int = 4000) -> None:
    """Rewrites the archives of ``source`` at ``target``: one response per payload, revisits for the others."""
    light = ("archive", "place", "record_type", "page_id", "uri", "date", "digest", "payload_bytes", "refers_to")
    headers = staged(read_archives(spark, source, payloads=False).select(*light), "headers")
    decisions = staged(resolve(headers, least), "decisions")
    records = read_archives(spark, source).drop("record_type", "refers_to").join(decisions.hint("merge"), ["archive", "place"])
    payload = F.when(F.col("record_type") == "response", F.decode("payload", "UTF-8"))
    write_archives(records.withColumn("payload", payload), target, archive_records)


def archived(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Writes one response record per page, resolves revisits, writes the deduplicated archives, and gives their
    records: ``page_id, payload_bytes, payload_digest, record_type, refers_to, archive``."""
    spark = pages.sparkSession
    raw, final = shared_path(spark, "warc-raw"), shared_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("uri"), F.lit(None).cast("string").alias("date"),
                        F.col(payload).cast("string").alias("payload"))
    write_archives(rows, raw)
    deduplicate(spark, raw, final, least)
    return read_archives(spark, final, payloads=False).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "archive")
