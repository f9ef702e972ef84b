"""WARC archives with revisit resolution.

Headers (id, url, payload digest, payload size) are taken by Spark functions and stored.  Digests of
payloads of at least ``LEAST`` bytes that occur more than once are aggregated to
their original, the record with the greatest id (map-side combine), and headers are joined
with the originals by (digest, salt), so a payload of a third of all pages is no hot group.
Headers of revisits are records already: fresh headers that name the original, and no
payload.  Pages whose key is not in a fixed-size bitmap of the revisits' keys are responses where they are
read; of the others only those that the bitmap holds by chance are joined with
their headers.  So payloads are not shuffled.  Archives (one gzip member a record) are
written and read by the data source ``warc_archive``, by byte ranges.  Headers are fresh: the
date is the job's, ids are UUIDs made from page and digest, so that revisits can name them, and revisits also
name their original's target and date.  Archives of other makers are read, too: any case and
spacing of header names, folded lines, digests in base 32, other record types.

Cases: null html is an empty payload, null url an empty target; equal rows with the
greatest id are all responses with equal records, equal rows of a lesser id all revisits; a null id is the least, and its record is a response if all are null;
very long payloads are one record; an empty table writes no archive; control characters in urls are percent-encoded in headers;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from .archives import BATCH, ArchiveWriter, RangeReader
from .storage import keyed_in, stored, temporary

#: Bytes from which equal payloads are stored once.
LEAST = 1000
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Names this writer's record ids are made in, and its header for the page.
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:x-page")
PAGE = "X-Page-ID"

SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, error string"


#: Parts into which the pages of one digest are dealt when they meet their original.
SALTS = 32


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, digest, payload_bytes, key, payload`` of every page; ``key`` stands for id and digest."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.sha1(payload).alias("digest"), F.length(payload).cast("long").alias("payload_bytes"), payload.alias("payload"))
    return rows.withColumn("key", F.xxhash64("page_id", "digest"))


def originals(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """``digest, original`` of payloads that occur in more than one record."""
    groups = heads.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
    return groups.filter(F.col("n") > 1).select(F.col("digest").alias("o_digest"), "original")


def resolved(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Records ``page_id, url, record_type, refers_to, digest, payload_bytes, payload, refers_url``; revisits have no payload."""
    whole = headers(pages, id_col, url_col, html_col)
    heads = stored(whole.drop("payload"), "warc-headers")
    first = originals(heads, least).withColumn("o_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = heads.join(first, (F.col("digest") == F.col("o_digest")) & (F.pmod(F.xxhash64("page_id"), F.lit(SALTS)) == F.col("o_salt")))
    met = stored(met.select("page_id", "url", "digest", "payload_bytes", "key", "original"), "warc-met")
    targets = met.filter(F.col("page_id").eqNullSafe(F.col("original"))).groupBy(F.col("digest").alias("t_digest")).agg(F.min("url").alias("refers_url"))
    targets = targets.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = met.filter(~F.col("page_id").eqNullSafe(F.col("original")))
    again = again.join(targets, (F.col("digest") == F.col("t_digest")) & (F.pmod(F.xxhash64("page_id"), F.lit(SALTS)) == F.col("t_salt")))
    revisits = stored(again.select("page_id", "url", "digest", "payload_bytes", "key", "original", "refers_url"), "warc-revisits")
    perhaps = keyed_in(revisits.select("key"))
    doubtful = heads.filter(perhaps("key")).join(revisits.select(F.col("key").alias("r_key")), F.col("key") == F.col("r_key"), "left_anti").select(F.col("key").alias("d_key")).distinct()
    doubtful = stored(doubtful, "warc-doubtful")
    response = lambda rows: rows.select("page_id", "url", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "digest", "payload_bytes", "payload", F.lit(None).cast("string").alias("refers_url"))
    out = response(whole.filter(~perhaps("key")))
    out = out.unionByName(revisits.select("page_id", "url", F.lit("revisit").alias("record_type"), F.col("original").alias("refers_to"), "digest", "payload_bytes", F.lit(None).cast("binary").alias("payload"), "refers_url"))
    if doubtful.isEmpty():
        return out
    chosen = keyed_in(doubtful.select("d_key"))
    return out.unionByName(response(whole.filter(perhaps("key")).filter(chosen("key")).join(doubtful.hint("merge"), F.col("key") == F.col("d_key"), "left_semi")))


def _id(page: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(SPACE, f'{page} {digest}').urn}>"


def _target(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(page: int | None, url: str, kind: str, refers: int | None, digest: str, size: int, payload: bytes | None, refers_url: str | None, date: str) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(page, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_target(url)}", f"WARC-Payload-Digest: sha1:{digest}", *([] if page is None else [f"{PAGE}: {page}"])]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers, digest)}", f"WARC-Refers-To-Target-URI: {_target(refers_url or '')}", f"WARC-Refers-To-Date: {date}", *([] if refers is None else [f"{PAGE}-Refers-To: {refers}"])]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _fields(lines: list[str]) -> dict[str, str]:
    """Headers by lower-case name; a line that begins with white space continues the one before."""
    out, name = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _hex_digest(stated: str) -> str | None:
    """A stated SHA-1 in hexadecimal, or None for none and other algorithms."""
    kind, _, value = stated.partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; ValueError if it is damaged. The payload is the body of an HTTP block, else the block."""
    try:
        raw = zlib.decompress(data, 31)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode(errors="replace").split("\r\n")
    fields = _fields(lines)
    if not version.startswith("WARC/1.") or not fields.get("content-length", "").isdigit():
        raise ValueError("record is damaged")
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record is damaged")
    payload, size = block, None
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = _fields(http.decode(errors="replace").split("\r\n")[1:]).get("content-length", "")
        size = int(size) if size.isdigit() else None
    stated = _hex_digest(fields.get("warc-payload-digest", ""))
    number = lambda name: int(fields[name]) if re.fullmatch(r"-?[0-9]+", fields.get(name, "")) else None
    kind = fields.get("warc-type")
    out = {"page_id": number(PAGE.lower()), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": None, "payload_digest": stated, "payload_bytes": size, "payload": None, "error": None}
    if kind == "revisit":
        return out | {"refers_to": number(f"{PAGE}-Refers-To".lower())}
    own = hashlib.sha1(payload).hexdigest()
    if stated not in (None, own):
        raise ValueError("payload and digest differ")
    return out | {"payload_digest": own, "payload_bytes": len(payload), "payload": payload}


class WarcWriter(ArchiveWriter):
    suffix = ".warc.gz"

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def members(self, batch: pa.RecordBatch) -> Iterator[bytes]:
        for i in range(batch.num_rows):
            yield _record(*(c[i].as_py() for c in batch.columns), self.date)


class WarcReader(RangeReader):
    suffix = ".warc.gz"

    def checked(self, data: bytes) -> dict:
        return parse_record(data)

    def boundaries(self, source: pa.NativeFile) -> array:
        """Ends of the gzip members, found by reading the archive once in pieces; what follows damage is one last member."""
        offsets, at, z = array("q", [0]), 0, zlib.decompressobj(31)
        while piece := source.read(1 << 18):
            at += len(piece)
            while piece:
                try:
                    z.decompress(piece, 1 << 22)
                    while not z.eof and z.unconsumed_tail:
                        z.decompress(z.unconsumed_tail, 1 << 22)
                except zlib.error:
                    while piece := source.read(1 << 20):
                        at += len(piece)
                    return array("q", [*offsets, at]) if offsets[-1] < at else offsets
                piece = z.unused_data
                if z.eof:
                    offsets.append(at - len(piece))
                    z = zlib.decompressobj(31)
        if offsets[-1] < at:
            offsets.append(at)
        return offsets

    def rows(self, members) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for archive, offset, record, error in members:
            rows.append(record or {"error": f"{archive} at {offset}: {error}"})
            size += len(rows[-1].get("payload") or b"") + 200
            if size >= BATCH:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


_ARROW = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for x in SCHEMA.split(", ")])


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def write_pages(pages: DataFrame, path: str | None = None, **columns) -> str:
    """Write every page as a WARC record; gives the directory."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    path = path or temporary(spark, "warc")
    resolved(pages, **columns).write.format("warc_archive").mode("append").save(path)
    return path


def load(spark, path: str, **options) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc_archive").options(**options).load(path)
