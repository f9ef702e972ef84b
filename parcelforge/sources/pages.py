"""Kinds and page counts of document files, read from their bytes: PDF page trees, TIFF directories, single images.

A PDF's objects are found by its cross-reference tables and streams, newest first; a file whose
references are damaged gets an error instead of a count. Nothing is rendered.
"""

from __future__ import annotations

import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FACTS = T.StructType([T.StructField("media_type", T.StringType()), T.StructField("page_count", T.IntegerType()), T.StructField("error", T.StringType())])
_SPACE = rb"[\x00\t\n\x0c\r ]"
_REFERENCE = rb"(\d+)" + _SPACE + rb"+\d+" + _SPACE + rb"+R"


class Damaged(ValueError):
    """Why a file's pages cannot be counted."""


def _number(entry: bytes, name: bytes, default: int | None = None) -> int:
    m = re.search(rb"/" + name + _SPACE + rb"*(\d+)(?!" + _SPACE + rb"+\d+" + _SPACE + rb"+R)", entry)
    if not m and default is None:
        raise Damaged(f"no {name.decode()}")
    return int(m[1]) if m else default


def _to(entry: bytes, name: bytes) -> int:
    m = re.search(rb"/" + name + _SPACE + rb"*" + _REFERENCE, entry)
    if not m:
        raise Damaged(f"no {name.decode()}")
    return int(m[1])


class _Pdf:
    def __init__(self, data: bytes):
        self.data, self.at, self.inside, self.root, self.streams = data, {}, {}, None, {}
        mark = data.rfind(b"startxref")
        m = re.compile(rb"startxref" + _SPACE + rb"*(\d+)").match(data, mark) if mark >= 0 else None
        if not m:
            raise Damaged("no cross-reference")
        todo, seen = [int(m[1])], set()
        while todo:
            place = todo.pop(0)
            if place not in seen:
                seen.add(place)
                entry = self._section(place)
                if self.root is None and b"/Root" in entry:
                    self.root = _to(entry, b"Root")
                todo += [int(x) for x in re.findall(rb"/(?:XRefStm|Prev)" + _SPACE + rb"*(\d+)", entry)]
        if self.root is None:
            raise Damaged("no Root")

    def _section(self, place: int) -> bytes:
        """Reads one table or stream of references; gives its trailer's entries."""
        data = self.data
        if data[place : place + 4] == b"xref":
            end = data.find(b"trailer", place)
            if end < 0:
                raise Damaged("no trailer")
            words = data[place + 4 : end].split()
            i = 0
            while i + 1 < len(words):
                first, n = int(words[i]), int(words[i + 1])
                for k in range(n):
                    offset, _, kind = words[i + 2 + 3 * k : i + 5 + 3 * k]
                    if kind == b"n":
                        self.at.setdefault(first + k, int(offset))
                i += 2 + 3 * n
            return data[end : data.find(b"startxref", end)]
        entry, body = self._stream(place)
        widths = [int(x) for x in re.search(rb"/W" + _SPACE + rb"*\[([^\]]*)\]", entry)[1].split()]
        index = re.search(rb"/Index" + _SPACE + rb"*\[([^\]]*)\]", entry)
        index = [int(x) for x in index[1].split()] if index else [0, _number(entry, b"Size")]
        step, row = sum(widths), 0
        for first, n in zip(index[::2], index[1::2], strict=True):
            for k in range(n):
                fields, at = [], row * step
                for w in widths:
                    fields.append(int.from_bytes(body[at : at + w], "big"))
                    at += w
                kind = fields[0] if widths[0] else 1
                if kind == 1 and first + k not in self.inside:
                    self.at.setdefault(first + k, fields[1])
                elif kind == 2 and first + k not in self.at:
                    self.inside.setdefault(first + k, (fields[1], fields[2]))
                row += 1
        return entry

    def _stream(self, place: int) -> tuple[bytes, bytes]:
        """Entries and decoded bytes of the stream object at a place."""
        m = re.compile(_SPACE + rb"*\d+" + _SPACE + rb"+\d+" + _SPACE + rb"+obj").match(self.data, place)
        begin = self.data.find(b"stream", place)
        if not m or begin < 0:
            raise Damaged("no object at a reference")
        entry = self.data[place:begin]
        begin += 6
        begin += 2 if self.data[begin : begin + 2] == b"\r\n" else 1
        body = self.data[begin : begin + _number(entry, b"Length")]
        if b"/FlateDecode" in entry:
            body = zlib.decompress(body)
        elif b"/Filter" in entry:
            raise Damaged("unknown filter")
        if _number(entry, b"Predictor", 1) >= 10:  # rows, each the difference to the one above
            n, above, rows = _number(entry, b"Columns", 1), None, []
            for k in range(0, len(body), n + 1):
                kind, own = body[k], bytearray(body[k + 1 : k + 1 + n])
                if kind == 2 and above is not None:
                    own = bytearray((x + y) & 255 for x, y in zip(own, above, strict=False))
                elif kind not in (0, 2):
                    raise Damaged("unknown predictor")
                rows.append(bytes(own))
                above = own
            body = b"".join(rows)
        return entry, body

    def entry(self, number: int) -> bytes:
        if number in self.at:
            place = self.at[number]
            m = re.compile(_SPACE + rb"*" + str(number).encode() + _SPACE + rb"+\d+" + _SPACE + rb"+obj").match(self.data, place)
            end = self.data.find(b"endobj", place)
            if not m or end < 0:
                raise Damaged("no object at a reference")
            return self.data[m.end() : end]
        if number not in self.inside:
            raise Damaged("a reference to nothing")
        holder, _ = self.inside[number]
        if holder not in self.streams:
            if holder not in self.at:
                raise Damaged("a reference to nothing")
            entry, body = self._stream(self.at[holder])
            head = [int(x) for x in body[: _number(entry, b"First")].split()]
            starts = [_number(entry, b"First") + x for x in head[1::2]]
            self.streams[holder] = {k: body[a:z] for k, a, z in zip(head[::2], starts, [*starts[1:], len(body)], strict=True)}
        try:
            return self.streams[holder][number]
        except KeyError as e:
            raise Damaged("a reference to nothing") from e

    def pages(self) -> int:
        """Leaves of the page tree, each node once."""
        todo, seen, n = [_to(self.entry(self.root), b"Pages")], set(), 0
        while todo:
            number = todo.pop()
            if number in seen:
                raise Damaged("the page tree has a circle")
            seen.add(number)
            entry = self.entry(number)
            kids = re.search(rb"/Kids" + _SPACE + rb"*\[([^\]]*)\]", entry)
            if kids:
                todo += [int(x) for x in re.findall(_REFERENCE, kids[1])]
            else:
                n += 1
        return n


def _tiff(data: bytes) -> int:
    order = "<" if data[:2] == b"II" else ">"
    big = struct.unpack_from(f"{order}H", data, 2)[0] == 43
    size, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    at, seen = struct.unpack_from(f"{order}{size}", data, 8 if big else 4)[0], set()
    while at:
        if at in seen:
            raise Damaged("the directories have a circle")
        seen.add(at)
        n = struct.unpack_from(f"{order}{count}", data, at)[0]
        at = struct.unpack_from(f"{order}{size}", data, at + struct.calcsize(f"{order}{count}") + n * entry)[0]
    if not seen:
        raise Damaged("no directory")
    return len(seen)


def facts_of(data: bytes | None) -> dict:
    """``media_type, page_count, error`` of a file's bytes; unknown kinds and damaged files have an error and no count."""
    data = data or b""
    kind = None
    try:
        if b"%PDF-" in data[:1024]:
            kind = "application/pdf"
            return {"media_type": kind, "page_count": _Pdf(data).pages()}
        if data[:4] in (b"II*\x00", b"MM\x00*", b"II+\x00", b"MM\x00+"):
            kind = "image/tiff"
            return {"media_type": kind, "page_count": _tiff(data)}
        for mark, name in ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg")):
            if data.startswith(mark):
                return {"media_type": name, "page_count": 1}
        return {"error": "empty" if not data else "unknown kind"}
    except Damaged as e:
        return {"media_type": kind, "error": str(e)}
    except (struct.error, zlib.error, ValueError, TypeError, IndexError):
        return {"media_type": kind, "error": "damaged"}


@F.arrow_udf(_FACTS)
def page_facts(content: pa.Array) -> pa.Array:
    return pa.array([facts_of(x) for x in content.to_pylist()], pa.struct([("media_type", pa.string()), ("page_count", pa.int32()), ("error", pa.string())]))


def counted(documents: DataFrame, content: Column | str = "content") -> DataFrame:
    """``documents`` with ``media_type, page_count, error`` of their bytes instead of these."""
    c = F.col(content) if isinstance(content, str) else content
    rows = documents.withColumn("__facts", page_facts(c))
    return rows.select(*(x for x in documents.columns if x != content), "__facts.media_type", "__facts.page_count", "__facts.error")
