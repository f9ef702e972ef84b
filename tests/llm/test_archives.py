import hashlib
import zlib
from pathlib import Path

import fixtures
import pytest
from pyspark.sql import functions as F

from parcelforge.llm import archives, media, warc


def test_media_round_trip(spark):
    docs = fixtures.documents(spark)
    out = media.with_features(media.load(spark, media.store_texts(docs), range_bytes="4096")).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        b = (r.text or "").encode()
        p = b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
        want.append((r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out), key=repr) == sorted(want, key=repr)
    by_text = {}
    for r in out:
        assert r.error is None and by_text.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_png_is_checked():
    payload = media.padded("grün".encode() * 400)
    png = media.encode_png(payload)
    assert media.decode_png(png) == payload
    with pytest.raises(ValueError):
        media.decode_png(png[:60] + bytes([png[60] ^ 1]) + png[61:])
    with pytest.raises(ValueError):
        media.decode_png(b"GIF89a")


def test_damaged_member_is_a_row_of_its_own(spark, tmp_path):
    at = f"file://{tmp_path}/m"
    media.store_texts(spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").coalesce(1), at)
    (file,) = Path(tmp_path, "m").glob("*.media")
    data = bytearray(file.read_bytes())
    data[-3] ^= 1
    file.write_bytes(bytes(data))
    rows = media.load(spark, at).collect()
    bad = [r for r in rows if r.error]
    assert len(rows) == 20 and len(bad) == 1 and bad[0].payload is None and "ValueError" in bad[0].error


def test_failed_reads_are_tried_again(monkeypatch, tmp_path):
    class Flaky(media.MediaReader):
        seen: dict = {}

        def checked(self, data):
            n = self.seen[data] = self.seen.get(data, 0) + 1
            if n < 3:
                raise OSError("lost")
            return super().checked(data)

    import pyarrow as pa

    w = media.MediaWriter({"path": f"{tmp_path}/a", "roll_bytes": "200"})
    w.commit([w.write(iter([pa.RecordBatch.from_arrays([pa.array([1, None, 3]), pa.array(["a", None, "c" * 900])], ["doc_id", "text"])]))])
    reader = Flaky({"path": f"{tmp_path}/a", "range_bytes": "100"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["error"]) for r in rows) == [(0, 0, None), (1, 1, None), (3, 900, None)]
    assert not list(Path(tmp_path, "a").glob("_open*")) and archives.ATTEMPTS == 3


def test_aborted_write_leaves_nothing(tmp_path):
    import pyarrow as pa

    w = media.MediaWriter({"path": f"{tmp_path}/b"})
    w.abort([w.write(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a"])], ["doc_id", "text"])]))])
    assert list(Path(tmp_path, "b").iterdir()) == []


def pages(spark):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a/", big), (2, "http://b/\r\n x", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "q", big), (9, "é", "ü" * 500), (10, "é", "ü" * 500), (11, "é", "ü" * 499 + "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_resolution(spark):
    rows = warc.load(spark, warc.write_pages(pages(spark)), range_bytes="300").collect()
    got = {r.page_id: (r.record_type, r.refers_to) for r in rows}
    assert len(rows) == 11 and all(r.error is None for r in rows)
    assert got == {1: ("revisit", 3), 2: ("revisit", 3), None: ("revisit", 3), 3: ("response", None), 9: ("revisit", 10), 10: ("response", None), 11: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    html = {r.page_id: (r.html or "").encode() for r in pages(spark).collect()}
    for r in rows:
        assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == hashlib.sha1(html[r.page_id]).hexdigest()
        assert r.payload == (None if r.record_type == "revisit" else html[r.page_id])


def test_warc_repeated_rows_clashing_names_and_chance_hits(spark, monkeypatch):
    """Equal rows share a type; columns named as those used inside; a bitmap so small that all keys are in it."""
    rows = pages(spark).unionByName(pages(spark)).withColumns({"digest": F.lit("d"), "key": F.lit(1), "payload": F.lit("p"), "original": F.lit(0)})
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.load(spark, warc.write_pages(rows)).collect())
    monkeypatch.setattr(warc, "keyed_in", lambda keys: lambda key: F.lit(True))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    again = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.load(spark, warc.write_pages(rows)).collect())
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == again and len(got) == 22 and [x[1] for x in got if x[0] == "3"] == ["response", "response"] and [x[1:] for x in got if x[0] == "1"] == [("revisit", 3)] * 2


def test_warc_headers_cannot_be_injected():
    data = warc._record(1, "http://a/\r\nWARC-Type: revisit", "response", None, hashlib.sha1(b"p").hexdigest(), 1, b"p", None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(data)["record_type"] == "response"
    with pytest.raises(ValueError):
        warc.parse_record(data[:-9])


def test_empty_tables(spark):
    assert warc.load(spark, warc.write_pages(pages(spark).limit(0))).count() == 0
    assert media.load(spark, media.store_texts(fixtures.empty(spark))).count() == 0


def test_a_job_counts_whole_or_not_at_all(tmp_path):
    """A driver lost before the manifest's rename leaves nothing to read; a named archive that is gone is no silent loss."""
    import pyarrow as pa

    one = lambda k: iter([pa.RecordBatch.from_arrays([pa.array([k]), pa.array([f"t{k}"])], ["doc_id", "text"])])
    first, lost = (media.MediaWriter({"path": f"{tmp_path}/c"}) for _ in range(2))
    first.write(one(9))  # an attempt that fails later
    first.commit([first.write(one(1)), None])
    lost.write(one(2))
    Path(tmp_path, "c", f"{lost.job}.open").write_text("[]")
    reader = media.MediaReader({"path": f"{tmp_path}/c"})
    assert [r["doc_id"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == [1]
    lost.abort([])
    assert not list(Path(tmp_path, "c").glob(f"{lost.job}*"))
    for f in Path(tmp_path, "c").glob("*.media"):
        f.unlink()
    with pytest.raises(FileNotFoundError):
        reader.partitions()


def by_hand(*records: bytes) -> bytes:
    import gzip

    return b"".join(gzip.compress(r) for r in records)


def test_archives_of_other_makers(spark, tmp_path):
    """No index, other header case and spacing, a folded line, base 32 digests, other record types, a damaged tail."""
    import base64

    body = b"<p>caf\xc3\xa9</p>" * 200
    http = b"HTTP/1.0 200 OK\r\ncontent-type:text/html\r\n\r\n" + body
    digest = base64.b32encode(hashlib.sha1(body).digest())
    info = b"software: by hand\r\n"
    records = [
        b"WARC/1.0\r\nwarc-type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n" % (len(info), info),
        b"WARC/1.0\r\nWARC-TYPE:response\r\nwarc-target-uri:  http://a/\r\nWarc-Payload-Digest: sha1:%s\r\nX-Note: folded\r\n over lines\r\nContent-type: application/http;msgtype=response\r\nCONTENT-LENGTH: %d\r\n\r\n%s\r\n\r\n" % (digest, len(http), http),
        b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Target-URI: http://b/\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % digest,
    ]
    Path(tmp_path, "x").mkdir()
    Path(tmp_path, "x", "crawl-1.warc.gz").write_bytes(by_hand(*records))
    Path(tmp_path, "x", "crawl-2.warc.gz").write_bytes(by_hand(records[1]) + b"torn" * 50)
    rows = warc.load(spark, f"file://{tmp_path}/x", range_bytes="50").collect()
    said = sorted((r.record_type or "", r.url or "", r.payload_bytes or 0, r.payload_digest or "", r.error is None) for r in rows)
    sha = hashlib.sha1(body).hexdigest()
    assert said == sorted([("warcinfo", "", len(info), hashlib.sha1(info).hexdigest(), True), ("response", "http://a/", len(body), sha, True), ("revisit", "http://b/", 0, sha, True), ("response", "http://a/", len(body), sha, True), ("", "", 0, "", False)])
    assert all(r.payload == body for r in rows if r.record_type == "response") and all(r.page_id is None for r in rows)


def test_fresh_headers(spark, tmp_path):
    """Ids of different records differ, revisits name their original's id, target and date."""
    import gzip

    at = Path(tmp_path, "w")
    warc.write_pages(pages(spark), f"file://{at}")
    heads = []
    for f in at.glob("*.warc.gz"):
        offsets = archives.np.frombuffer(Path(f"{f}.idx").read_bytes(), "<i8")
        heads += [warc._fields(gzip.decompress(f.read_bytes()[a:b]).partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:]) for a, b in zip(offsets, offsets[1:], strict=False)]
    ids = {h["warc-record-id"]: h for h in heads}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert len(ids) == 11 and len(revisits) == 4 and len({h["warc-date"] for h in heads}) == 1
    for h in revisits:
        first = ids[h["warc-refers-to"]]
        assert first["warc-type"] == "response" and first["warc-target-uri"] == h["warc-refers-to-target-uri"] and first["warc-date"] == h["warc-refers-to-date"] and first["warc-payload-digest"] == h["warc-payload-digest"]
