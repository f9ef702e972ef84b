"""Suffix-array dedup: bytes covered by a ``length``-byte string that also starts earlier go.

1. Anchors: the least ``GRAM``-byte hash inside each window of ``length`` bytes.  Equal windows
   have equal anchors, at equal places, so a window whose anchor occurs once cannot repeat; it is
   not shuffled.  Anchors are counted with map-side combine.
2. Runs of windows with one repeated anchor become fragments, of at most ``CHUNK`` windows, dealt
   out by anchor.  An equal fragment that the same task saw at an earlier place is a
   repeat whole, and is not shuffled.  Anchors with more than ``hot`` fragments would be hot keys: their
   equal fragments from all tasks are merged first, dealt out by fragment; where more than
   ``hot`` different ones remain (the edges of a passage that many texts share), they are split into single
   windows, and those that occur twice are dealt out by their own hash, merged by salt.
3. Each bucket of fragments, some MB, gets a suffix array by two-stage sorting: only suffixes
   smaller than their successors are sorted directly; scanning the buckets of first bytes
   from the least on then induces all others in order.  Adjacent common prefixes of at
   least ``length`` bytes join equal windows; all but the earliest of each group repeat.
4. Repeats become spans of their documents.  Only texts with spans are shuffled, all others pass where they are read.

Scale: a bucket of anchors holds at most ``hot`` fragments an anchor, whatever the input.  Bitmaps of repeated
anchors, hot anchors and touched texts have 16 to 32 bits a key, at most ``MOST_BITS``
(8 MB); with more than 4 million keys they let more windows and texts into the shuffle, with the same result.
Texts longer than ``PART`` bytes are read in overlapping parts.  The array compares bytes; hashes of 64 bits
only choose buckets, but two fragments whose anchor and fragment hash are both equal (128 bits) are taken for equal.

Cases: null text is empty; null ids come after all others and are equal; rows that repeat an id
count as one document whose strings start where they start in each row, and of equal starts none is
earlier; ids and texts may both repeat; an empty table gives no rows; other columns are passed on if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import drop, in_bitmap, keyed_in, slots_bitmap, stored
from .words import _BYTE_POWERS, _VALUES, mix, string_bytes

LENGTH, GRAM = 100, 32
#: Windows in one fragment.
CHUNK = 64
#: Fragments from which an anchor is hot.
HOT = 1024
#: Parts in which equal windows of hot anchors are merged first.
SALTS = 256
MOST_BITS = 1 << 26
#: Bytes of text handled at once, bytes of fragments in one block of a task, and in one suffix array.
PART, FLUSH, BUCKET = 1 << 18, 1 << 22, 1 << 20
LAST = (1 << 63) - 1

OUT = "n_bytes long, n_removed long, removed array<struct<start:int,end:int>>, kept binary"
_FRAGMENTS = "key long, kind long, doc long, row long, start int, n int, bytes binary"
_SPANS = "doc long, row long, lo int, hi int"
_U = np.uint64


def _sliding(a: np.ndarray, width: int, better) -> np.ndarray:
    """``better`` (np.minimum or np.maximum) of every ``width`` entries that follow each other."""
    have = 1
    while have < width:
        step = min(have, width - have)
        if len(a) <= step:
            return a[:0]
        a, have = better(a[:-step], a[step:]), have + step
    return a


class _Part:
    """Bytes of some whole texts, or of a part of one long text: hashes and anchors of its windows.

    ``text`` is the row of each text in its batch, ``bounds`` the texts' places in ``data``, ``shift`` where the part starts in its text.
    """

    def __init__(self, data: np.ndarray, text: np.ndarray, bounds: np.ndarray, shift: int, length: int):
        self.data, self.text, self.bounds, self.shift, self.length = data, text, bounds, shift, length
        up, self.down = _BYTE_POWERS.to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_VALUES[1][data] * up[:-1], out=self.sums[1:])

    def hashes(self, starts: np.ndarray | slice, size) -> np.ndarray:
        """Rabin-Karp hash of ``size`` bytes from each start."""
        ends = slice(starts.start + size, starts.stop + size) if isinstance(starts, slice) else starts + size
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + np.asarray(size).astype(_U))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """GRAM hashes of all places; the anchors of all windows, and which of those stay within a text."""
        n, gram = len(self.data), min(GRAM, self.length)
        grams = self.hashes(slice(0, n - gram + 1), gram)
        least = _sliding(grams, self.length - gram + 1, np.minimum)
        inside = np.ones(len(least), bool)
        for edge in self.bounds[1:-1]:
            inside[max(0, edge - self.length + 1) : edge] = False
        return grams, least, inside


def _parts(column: pa.Array, length: int) -> Iterator[_Part]:
    data, at = string_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        size = at[i + 1] - at[i]
        if size > PART:
            for lo in range(0, int(size) - length + 1, PART):
                own = data[at[i] + lo : min(at[i] + lo + PART + length - 1, at[i + 1])]
                yield _Part(own, np.array([i]), np.array([0, len(own)]), lo, length)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(at, at[i] + PART, "right")) - 1)
        if at[j] - at[i] >= length:
            yield _Part(data[at[i] : at[j]], np.arange(i, j), at[i : j + 1] - at[i], 0, length)
        i = j


def _tallied(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.sum("n").alias("n"))


def _tally(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    some, size = [], 0

    def flush():
        k, n = np.unique(np.concatenate(some), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["key", "n"])

    for keys in found:
        some.append(keys)
        size += len(keys)
        if size >= 1 << 20:
            yield flush()
            some, size = [], 0
    if size:
        yield flush()


def _anchor_places(rows: DataFrame, length: int) -> DataFrame:
    """``key, n``: places that are the anchor of a window, by hash.  Those where two parts of a long text overlap may count twice."""

    def count(batches):
        def found():
            for b in batches:
                for p in _parts(b.column(0), length):
                    grams, least, inside = p.anchors()
                    width = length - min(GRAM, length) + 1
                    some = np.concatenate([np.zeros(width - 1, _U), np.where(inside, least, _U(0)), np.zeros(width - 1, _U)])
                    yield grams[grams == _sliding(some, width, np.maximum)]

        yield from _tally(found())

    return _tallied(rows.select("text").mapInArrow(count, "key long, n long"))


def _runs(p: _Part, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of windows and anchors of the runs whose anchor is in the bitmap."""
    _, least, inside = p.anchors()
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), least
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])])
    new[p.bounds[1:-1][p.bounds[1:-1] < len(new)]] = True
    at = np.flatnonzero(new)
    n = np.diff(np.concatenate([at, [len(least)]]))
    own = inside[at]
    own[own] = in_bitmap(repeated, least[at[own]])
    return at[own], n[own], least[at[own]]


def _spread(starts: np.ndarray, n: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of at most ``step`` of each range: their starts, lengths and ranges."""
    k = -(-n // step)
    of = np.repeat(np.arange(len(n)), k)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
    return starts[of] + nth * step, np.minimum(step, n[of] - nth * step), of


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of ``data`` one after the other, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)], offsets


def _earliest(order: np.ndarray, same: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: the first row of each group (``same``: as the row before), and which rows are later than it."""
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    d, s = doc[order], start[order]
    return first, (d > d[first]) | (s > s[first])


def _collapsed(key, kind, doc, row, start, n, data, places, sizes) -> Iterator[pa.RecordBatch]:
    """Fragments, whose bytes are ``sizes`` of ``data`` from ``places``: equal ones later than another become ranges without bytes."""
    order = np.lexsort((row, start, doc, kind, key))
    same = np.concatenate([[False], (key[order][1:] == key[order][:-1]) & (kind[order][1:] == kind[order][:-1])])
    _, later = _earliest(order, same, doc, start)
    again = same & ~later & np.concatenate([[False], row[order][1:] == row[order][:-1]])  # equal rows
    gone = order[later]
    if len(gone):  # neighbours in a text become one
        g = gone[np.lexsort((start[gone], row[gone], doc[gone]))]
        new = np.concatenate([[True], (doc[g][1:] != doc[g][:-1]) | (row[g][1:] != row[g][:-1]) | (start[g][1:] > start[g][:-1] + n[g][:-1])])
        at = np.flatnonzero(new)
        lo, hi = start[g][at], np.maximum.reduceat(start[g] + n[g], at)
        zero = np.zeros(len(at), np.int64)
        yield _batch(zero, zero, doc[g][at], row[g][at], lo, hi - lo, pa.nulls(len(at), pa.binary()))
    keep = np.sort(order[~later & ~again])
    yield _batch(key[keep].view(np.int64), kind[keep].view(np.int64), doc[keep], row[keep], start[keep], n[keep], _blobs(data, places[keep], sizes[keep]))


def _fragments(rows: DataFrame, length: int, repeated) -> DataFrame:
    """Fragments of all candidate windows; those without bytes repeat an earlier one of the same task."""

    def cut(batches):
        some, size = [], 0

        def flush():
            columns = [np.concatenate([x[k] for x in some]) for k in range(6)]
            sizes = columns[5] + length - 1
            return _collapsed(*columns, np.concatenate([x[6] for x in some]), np.cumsum(sizes) - sizes, sizes)

        for b in batches:
            docs, keys = b.column(1).to_numpy(), b.column(2).to_numpy()
            for p in _parts(b.column(0), length):
                at, n, key = _runs(p, repeated.value)
                at, n, of = _spread(at, n, CHUNK)
                if len(at):
                    text = np.searchsorted(p.bounds, at, "right") - 1
                    data, _ = _gather(p.data, at, n + length - 1)
                    some.append((key[of], p.hashes(at, n + length - 1), docs[p.text[text]], keys[p.text[text]], at - p.bounds[text] + p.shift, n, data))
                    size += len(data)
                    if size >= FLUSH:
                        yield from flush()
                        some, size = [], 0
        if size:
            yield from flush()

    return rows.select("text", "doc", "row").mapInArrow(cut, _FRAGMENTS)


def _blobs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    out, to = _gather(data, starts, sizes)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(to.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def _batch(key, kind, doc, row, start, n, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind), pa.array(doc), pa.array(row), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), blobs], ["key", "kind", "doc", "row", "start", "n", "bytes"])


def _merged(fragments: DataFrame, *by: str) -> DataFrame:
    """Equal fragments dealt out by ``by``: those later than another lose their bytes."""

    def merge(batches):
        last = None  # the first of the group that the last batch ended in
        for b in batches:
            key, kind, doc, start = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("key", "kind", "doc", "start"))
            if last is not None:
                key, kind, doc, start = (np.concatenate([[x], y]) for x, y in zip(last, (key, kind, doc, start), strict=True))
            if len(key):
                same = np.concatenate([[False], (key[1:] == key[:-1]) & (kind[1:] == kind[:-1])])
                first, later = _earliest(np.arange(len(key)), same, doc, start)
                skip = int(last is not None)
                last = tuple(x[first[-1]] for x in (key, kind, doc, start))
                blobs = b.column(b.num_columns - 1)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.compute.if_else(pa.array(later[skip:]), pa.scalar(None, blobs.type), blobs)], names=b.schema.names)

    dealt = fragments.repartition(*by).sortWithinPartitions("key", "kind", "doc", "start", "row").select(*(x.split(" ")[0] for x in _FRAGMENTS.split(", ")))
    return dealt.mapInArrow(merge, _FRAGMENTS)


def _windows_of(b: pa.RecordBatch, length: int):
    """The bytes of a batch of fragments, the places of all their windows, their fragments, and the windows' hashes."""
    data, offsets = string_bytes(b.column(b.schema.get_field_index("bytes")))
    n = b.column(b.schema.get_field_index("n")).to_numpy().astype(np.int64)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    at, _, of = _spread(offsets[:-1], n, 1)
    part = _Part(data, np.zeros(1, np.int64), offsets[[0, -1]], 0, length)
    return data, at, of, at - offsets[of], part.hashes(at, length)


def _split(fragments: DataFrame, often: DataFrame, length: int) -> DataFrame:
    """Single windows of fragments, as fragments of their own dealt out by their hash; those that occur once are left out.

    Some thousand fragments of an anchor (``often``: ``key, n``) meet first, so that their many equal windows leave them once.
    """

    def count(batches):
        yield from _tally(_windows_of(b, length)[4] for b in batches if b.num_rows)

    several = stored(_tallied(fragments.mapInArrow(count, "key long, n long")).filter("n > 1"), "hot-windows")
    wanted = _bitmap(several.select("key"))
    drop(several)

    def split(batches):
        for b in batches:
            if b.num_rows:
                data, at, of, nth, hashes = _windows_of(b, length)
                own = in_bitmap(wanted.value, hashes)
                at, of, nth, key = at[own], of[own], nth[own], hashes[own]
                doc, row, start = (b.column(b.schema.get_field_index(x)).to_numpy()[of] for x in ("doc", "row", "start"))
                one = np.ones(len(at), np.int64)
                yield from _collapsed(key, key, doc, row, start + nth, one, data, at, one * length)

    near = fragments.join(often.select(F.col("key").alias("o_key"), F.col("n").alias("o_n")), F.col("key") == F.col("o_key"), "left")
    near = near.withColumn("salt", F.pmod(F.xxhash64("kind"), F.greatest(F.lit(1), F.expr("coalesce(o_n, 1) div 4096"))))
    near = near.repartition("key", "salt").sortWithinPartitions("key").select(*fragments.columns)
    ready = stored(near.mapInArrow(split, _FRAGMENTS), "split-windows")
    salted = ready.filter("bytes is not null").withColumn("salt", F.pmod(F.xxhash64("doc", "row"), F.lit(SALTS)))
    return _merged(salted, "key", "salt").unionByName(ready.filter("bytes is null"))


def suffix_order(t: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``wanted`` (marked) suffixes of ``t`` in order, by two-stage sorting, exact to ``depth`` bytes.

    A suffix smaller than its successor is sorted directly.  The others are induced: scanning all
    suffixes from the least on, the one before each, if larger, is the next of its bucket of first
    bytes.  A whole bucket is scanned at once; within it, suffixes that start with a run of its byte take one more round a byte.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    turn = np.flatnonzero(t[1:] != t[:-1])  # the last place of each run
    to = np.concatenate([turn, [n - 1]])[np.searchsorted(turn, np.arange(n))]
    up = np.zeros(n, bool)
    up[:-1] = (t[to] < t[np.minimum(to + 1, n - 1)])[:-1]
    # what wanted suffixes are induced from: all places up to the next that is sorted directly
    stop = np.flatnonzero(up)
    ends = np.concatenate([stop, [n - 1]])[np.searchsorted(stop, np.arange(n))]
    marks = np.zeros(n + 1, np.int32)
    some = np.flatnonzero(wanted)
    np.add.at(marks, some, 1)
    np.subtract.at(marks, ends[some] + 1, 1)
    needed = np.cumsum(marks[:-1]) > 0
    direct = np.flatnonzero(needed & up)
    if needed[n - 1]:
        direct = np.concatenate([[n - 1], direct])
    padded = np.concatenate([t, np.zeros(depth, t.dtype)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    order, step = [], 1 << 17
    if len(direct) <= step:
        order = direct[np.argsort(np.ascontiguousarray(rows[direct]).view(f"S{depth}").ravel(), kind="stable")]
    else:  # by first bytes, so that few prefixes are copied at once
        head = t[direct].astype(np.int32) * 256 + padded[direct + 1]
        by = np.argsort(head, kind="stable")
        edges = np.searchsorted(head[by], np.unique(head))
        for part in np.split(direct[by], edges[1:]):
            order.append(part[np.argsort(np.ascontiguousarray(rows[part]).view(f"S{depth}").ravel(), kind="stable")])
        order = np.concatenate(order)
    begin = np.searchsorted(t[order], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    larger = needed & ~up
    larger[n - 1] = False
    for c in range(256):
        level = np.concatenate(induced[c]) if induced[c] else order[:0]
        scanned = []
        while len(level):  # rounds within a run of the byte c
            scanned.append(level)
            before = level[level > 0] - 1
            level = before[larger[before] & (t[before] == c)]
        scanned.append(order[begin[c] : begin[c + 1]])
        scanned = np.concatenate(scanned)
        if len(scanned):
            out.append(scanned)
            before = scanned[scanned > 0] - 1
            before = before[larger[before] & (t[before] > c)]
            by = np.argsort(t[before], kind="stable")
            before = before[by]
            edges = np.flatnonzero(np.diff(t[before])) + 1
            for part in np.split(before, edges) if len(before) else ():
                induced[t[part[0]]].append(part)
    out = np.concatenate(out) if out else order
    return out[wanted[out]]


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in ``order``, at most ``most``; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    padded = np.concatenate([t, np.zeros(most + 8, t.dtype)])
    words = np.zeros(len(padded) - 7, _U)
    for k in range(8):
        words = (words << _U(8)) | padded[k : len(padded) - 7 + k].astype(_U)
    alike = np.arange(1, len(order))
    for at in range(0, most, 8):
        x = words[order[alike] + at] ^ words[order[alike - 1] + at]
        differ = x != 0
        d = x[differ]
        same = np.zeros(len(d), np.int64)
        for k in range(1, 8):
            same += d >> _U(64 - 8 * k) == 0
        out[alike[differ]] = at + same
        alike = alike[~differ]
    out[alike] = most
    return np.minimum(out, most)


def _repeats(key, kind, doc, row, start, n, data, offsets, length: int) -> pa.RecordBatch:
    """Spans of window starts that repeat an earlier window, of all fragments of one bucket."""
    order = np.lexsort((row, start, doc, kind, key))
    same = np.concatenate([[False], (key[order][1:] == key[order][:-1]) & (kind[order][1:] == kind[order][:-1])])
    first, later = _earliest(order, same, doc, start)
    spans = [(doc[order][later], row[order][later], start[order][later], (start + n)[order][later])]
    tied = np.flatnonzero(~later)  # of each kind its first fragment, and those with equal id and start
    heads = np.flatnonzero(~same)
    of = np.searchsorted(heads, first[tied])
    kinds = order[heads]
    sizes = n[kinds] + length - 1
    flat, to = _gather(data, offsets[kinds], sizes)
    t = np.zeros(len(flat) + len(kinds), np.uint8)  # bytes of UTF-8 plus one, so that 0 ends a fragment
    base = to[:-1] + np.arange(len(kinds))
    t[np.arange(len(flat)) + np.repeat(np.arange(len(kinds)), sizes)] = flat + 1
    marks = np.zeros(len(t) + 1, np.int32)
    marks[base] += 1
    marks[base + n[kinds]] -= 1
    wanted = np.cumsum(marks[:-1]) > 0
    array = suffix_order(t, wanted, length)
    group = np.flatnonzero(common_prefixes(t, array, length) < length)
    own = np.searchsorted(base, array, "right") - 1
    d, s = doc[kinds][own], start[kinds][own] + array - base[own]
    sizes = np.diff(np.concatenate([group, [len(array)]]))
    least = np.repeat(np.minimum.reduceat(d, group), sizes)
    begin = np.repeat(np.minimum.reduceat(np.where(d == least, s, LAST), group), sizes)
    repeat = np.zeros(len(t) + 1, np.int8)
    repeat[array[(d > least) | (s > begin)]] = 1
    edge = np.diff(np.concatenate([[0], repeat]))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    own = np.searchsorted(base, lo, "right") - 1
    # each run belongs to all fragments tied as the first of its kind
    ties = np.bincount(of, minlength=len(kinds))
    many = ties[own]
    run = np.repeat(np.arange(len(lo)), many)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
    at = order[tied[np.searchsorted(of, own[run]) + nth]]
    spans.append((doc[at], row[at], start[at] + lo[run] - base[own[run]], start[at] + hi[run] - base[own[run]]))
    doc, row, lo, hi = (np.concatenate([x[k] for x in spans]) for k in range(4))
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(row), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["doc", "row", "lo", "hi"])


def _array_repeats(carriers: DataFrame, length: int) -> DataFrame:
    """Spans of the fragments, dealt out in buckets of about BUCKET bytes; one suffix array a block of whole buckets."""
    total = carriers.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    buckets = max(64, 2 * total // BUCKET)

    def blocks(batches):
        some, size, now = [], 0, None
        for b in batches:
            bucket = b.column(0).to_numpy()
            at = np.flatnonzero(np.diff(bucket)) + 1
            for lo, hi in zip(np.concatenate([[0], at]), np.concatenate([at, [b.num_rows]]), strict=True):
                if hi > lo:
                    if size >= BUCKET and bucket[lo] != now:
                        yield some
                        some, size = [], 0
                    part = b.slice(lo, hi - lo)
                    some.append(part)
                    size += part.column(b.num_columns - 1).nbytes
                    now = bucket[lo]
        if some:
            yield some

    def repeats(batches):
        for some in blocks(batches):
            whole = pa.Table.from_batches(some)
            key, kind, doc, row, start, n = (whole[x].to_numpy() for x in ("key", "kind", "doc", "row", "start", "n"))
            data, offsets = string_bytes(whole["bytes"])
            yield _repeats(key, kind, doc, row, start.astype(np.int64), n.astype(np.int64), data, offsets, length)

    dealt = carriers.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "kind", "doc", "row", "start", "n", "bytes")
    return dealt.repartition(max(8, buckets // 4), "bucket").sortWithinPartitions("bucket").mapInArrow(repeats, _SPANS)


def _bits(n: int) -> int:
    """Bits of a bitmap: 16 to 32 a key, MOST_BITS at most."""
    return min(MOST_BITS, max(1 << 16, 1 << (16 * n).bit_length()))


def _bitmap(keys: DataFrame):
    return keys.sparkSession.sparkContext.broadcast(slots_bitmap(keys, _bits(keys.count())))


def _cut(column: pa.Array, spans: pa.Array, length: int) -> list[pa.Array]:
    """OUT's columns for texts and their spans of repeated window starts."""
    data, at = string_bytes(column)
    to = spans.offsets.to_numpy() - spans.offsets[0].as_py()
    lo, hi = (spans.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
    n_removed, removed, kept = [], [], []
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PART, "right")) - 1)
        base = at[i : j + 1] - at[i]
        own = np.repeat(base[:-1], np.diff(to[i : j + 1]))
        marks = np.zeros(base[-1] + 1, np.int32)
        np.add.at(marks, own + lo[to[i] : to[j]], 1)
        np.subtract.at(marks, own + hi[to[i] : to[j]] - 1 + length, 1)
        gone = np.cumsum(marks[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])[base]
        n_removed.append(np.diff(total))
        first = np.zeros(len(gone), bool)  # spans end with their texts
        first[base[:-1][base[:-1] < len(gone)]] = True
        starts = np.flatnonzero(gone & (first | np.concatenate([[True], ~gone[:-1]])))
        last = np.ones(len(gone), bool)
        last[:-1] = first[1:]
        ends = np.flatnonzero(gone & (last | np.concatenate([~gone[1:], [True]]))) + 1
        text = np.searchsorted(base, starts, "right") - 1
        offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=j - i))]).astype(np.int32)
        removed.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array((x - base[text]).astype(np.int32)) for x in (starts, ends)], ["start", "end"])))
        left, places = data[at[i] : at[j]][~gone], (base - total).astype(np.int32)
        kept.append(pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(left.tobytes())]))
        i = j
    return [pa.array(np.diff(at)), pa.array(np.concatenate(n_removed)), pa.concat_arrays(removed), pa.concat_arrays(kept)]


def dedup(docs: DataFrame, keep: Sequence[str] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and OUT's: removed byte spans, and the bytes that are left."""
    ids, text = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(text.alias("text"), ids.alias("doc"), F.xxhash64(text).alias("row"))

    places = stored(_anchor_places(rows, length).filter("n > 1").select("key"), "anchors")
    fragments = stored(_fragments(rows, length, _bitmap(places)), "fragments")
    drop(places)
    ready, tables = fragments, [fragments]
    for merge in (lambda df, often: _merged(df, "key", "kind"), lambda df, often: _split(df, often, length)):
        often = stored(ready.filter("bytes is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot), "hot-anchors")
        if often.isEmpty():
            break
        is_hot = keyed_in(often.select("key"), _bits(often.count()))(F.col("key"))
        marked = ready.withColumn("hot", F.col("bytes").isNotNull() & is_hot)
        merged = stored(merge(marked.filter("hot").drop("hot"), often), "hot-fragments")
        ready = marked.filter("not hot").drop("hot").unionByName(merged)
        tables.append(merged)
        drop(often)
    found = ready
    gone = found.filter("bytes is null").select("doc", "row", F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))
    spans = gone.unionByName(_array_repeats(found.filter("bytes is not null"), length))
    spans = stored(spans.groupBy(F.col("doc").alias("s_doc"), F.col("row").alias("s_row")).agg(F.collect_set(F.struct("lo", "hi")).alias("__spans")), "spans")
    drop(*tables)
    touched = _bitmap(spans.select(F.xxhash64("s_doc", "s_row")))

    whole = docs.select(*keep, F.xxhash64(ids, F.xxhash64(text)).alias("__touch"), ids.alias("__doc"), F.xxhash64(text).alias("__row"), text.alias("__text"))
    schema = T.StructType([*whole.schema.fields[:-4], *T.StructType.fromDDL(OUT).fields])

    def picked(batches, inside: bool):
        for b in batches:
            yield b.filter(pa.array(in_bitmap(touched.value, b.column(b.num_columns - 4).to_numpy().view(np.uint64)) == inside))

    def untouched(batches):
        none = pa.array([], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
        for b in picked(batches, False):
            spans = pa.ListArray.from_arrays(pa.array(np.zeros(b.num_rows + 1, np.int32)), none.values)
            yield from cut([b.append_column("__spans", spans)])

    def candidates(batches):
        yield from picked(batches, True)

    def cut(batches):
        for b in batches:
            if b.num_rows:
                spans = pa.compute.coalesce(b.column(b.num_columns - 1), pa.scalar([], b.column(b.num_columns - 1).type))
                yield pa.RecordBatch.from_arrays([*b.columns[:-5], *_cut(b.column(b.num_columns - 2), spans, length)], names=schema.names)

    at_rest = whole.mapInArrow(untouched, schema)
    joined = whole.mapInArrow(candidates, whole.schema).join(spans.hint("merge"), (F.col("__doc") == F.col("s_doc")) & (F.col("__row") == F.col("s_row")), "left").drop("s_doc", "s_row")
    return at_rest.unionByName(joined.mapInArrow(cut, schema))
