import struct
import zlib

import pytest

from parcelforge.sources import files, pages


def pdf(n, fan=3, packed=False, prev=False):
    """A PDF of ``n`` pages in a tree of ``fan`` kids a node, with a table or a packed stream of references."""
    objects, level = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}, []
    number = 3
    for _ in range(n):
        objects[number] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 9 9] >>"
        level.append(number)
        number += 1
    while len(level) > fan:
        above = []
        for k in range(0, len(level), fan):
            objects[number] = b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % x for x in level[k : k + fan]) + b"] >>"
            above.append(number)
            number += 1
        level = above
    objects[2] = b"<< /Type /Pages /Kids [ " + b"\n".join(b"%d 0 R" % x for x in level) + b" ] /Count %d >>" % n
    out, at = bytearray(b"%PDF-1.7\n%\xe2\xe3\n"), {}

    def put(k, body):
        at[k] = len(out)
        out.extend(b"%d 0 obj\n" % k + body + b"\nendobj\n")

    if not packed:
        for k, body in objects.items():
            put(k, body)
        start = len(out)
        out.extend(b"xref\n0 %d\n0000000000 65535 f \n" % number + b"".join(b"%010d 00000 n \n" % at[k] for k in range(1, number)) + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (number, start))
        if prev:  # an update that adds a page at the top
            put(number, b"<< /Type /Page >>")
            put(2, objects[2].replace(b"/Kids [", b"/Kids [%d 0 R " % number))
            second = len(out)
            out.extend(b"xref\n2 1\n%010d 00000 n \n%d 1\n%010d 00000 n \ntrailer\n<< /Size %d /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at[2], number, at[number], number + 1, start, second))
        return bytes(out)
    keys, bodies, head = list(objects), b"", b""
    for k in keys:
        head += b"%d %d " % (k, len(bodies))
        bodies += objects[k] + b" "
    body = zlib.compress(head + bodies)
    put(number, b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(keys), len(head), len(body)) + body + b"\nendstream")
    start = len(out)
    table = [(0, 0, 0)] + [(2, number, keys.index(k)) if k in objects else (1, at.get(k, start), 0) for k in range(1, number + 2)]
    rows = [struct.pack(">BIH", *x) for x in table]
    packed_rows = b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(r, rows[k - 1] if k else bytes(7), strict=True)) for k, r in enumerate(rows))
    body = zlib.compress(packed_rows)
    out.extend(b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >> /Length %d >>\nstream\n" % (number + 1, number + 2, len(body)) + body + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % start)
    return bytes(out)


def tiff(n, order="<", big=False):
    head, size, count, entry = (16, "Q", "Q", 20) if big else (8, "I", "H", 12)
    out = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}H", 43 if big else 42) + (struct.pack(f"{order}HH", 8, 0) if big else b"") + struct.pack(f"{order}{size}", head if n else 0)
    step = struct.calcsize(f"{order}{count}") + 2 * entry + struct.calcsize(size)
    for k in range(n):
        out += struct.pack(f"{order}{count}", 2) + bytes(2 * entry) + struct.pack(f"{order}{size}", 0 if k == n - 1 else head + (k + 1) * step)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 47])
def test_counts(n):
    for data in (pdf(n), pdf(n, packed=True)):
        assert pages.facts_of(data) == {"media_type": "application/pdf", "page_count": n}
    assert pages.facts_of(pdf(n, prev=True))["page_count"] == n + 1
    for order in "<>":
        for big in (False, True):
            assert pages.facts_of(tiff(n, order, big)) == {"media_type": "image/tiff", "page_count": n}


def test_damaged_files_have_an_error():
    whole = pdf(5)
    cases = [None, b"", b"text", whole[:-60], whole.replace(b"/Pages 2 0 R", b"/Pages 99 0 R"), whole.replace(b"/Root 1 0 R", b"/Wood 1 0 R"), whole.replace(b"/Type /Page /Parent", b"/Kids [2 0 R] /Paren"), tiff(0), tiff(3)[:40], b"II*\x00" + struct.pack("<I", 8) + struct.pack("<H", 0) + struct.pack("<I", 8), pdf(3, packed=True).replace(b"/W [1 4 2]", b"/W [1 4 x]")]
    for data in cases:
        facts = pages.facts_of(data)
        assert facts.get("page_count") is None and facts["error"], data
    assert pages.facts_of(b"\x89PNG\r\n\x1a\nrest")["page_count"] == pages.facts_of(b"\xff\xd8\xffrest")["page_count"] == 1


def test_files_of_a_folder(spark, tmp_path):
    for name, data in {"a.pdf": pdf(7), "b.tif": tiff(3), "c.pdf": pdf(2)[:-40], "d.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    rows = pages.counted(files.documents(spark, str(tmp_path))).collect()
    got = {r.path.rsplit("/", 1)[1]: (r.media_type, r.page_count, r.error is None) for r in rows}
    assert got == {"a.pdf": ("application/pdf", 7, True), "b.tif": ("image/tiff", 3, True), "c.pdf": ("application/pdf", None, False), "d.txt": (None, None, False)}
