"""Substring dedup: words covered by a window that also starts in an earlier document go.

A window is ``WINDOW`` consecutive words; its Rabin-Karp hash is computed for every
place.  Steps, each over all documents:

1. Anchors: the least 4-gram hash inside each window.  Equal windows have equal
   anchors, so a window whose anchor occurs in one document only cannot repeat and is
   not shuffled.  Anchors are counted with map-side combine; the repeated ones set a
   bitmap of fixed size (when it fills up at very large inputs, more windows are
   shuffled, the result stays the same).
2. Hot windows: windows around anchors in more than ``hot`` documents are counted with
   map-side combine too.  Those in more than ``hot`` documents, at most ``HOT_ROWS`` by
   choice of ``hot``, are broadcast with their first document, so no task gets all
   occurrences of a frequent passage.
3. All other windows with repeated anchors are dealt out by hash, in packed blocks;
   windows of later documents are sent back, and merged into maximal intervals per document.
   Documents that got intervals set a bitmap of fixed size; only texts in it are
   joined with their intervals, all others pass through where they are read.

Hashes have 64 bits: with n candidate windows about n * n / 2**65 unequal pairs
would be taken for equal.

Cases: null text has no words; texts shorter than a window are kept whole; null ids
come after all others and are equal; rows that repeat an id are judged one by one, and an equal id is not
a smaller one; an empty table gives no rows; other columns are passed on if asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import drop, in_bitmap, slots_bitmap, stored
from .words import Piece, ngram_hashes, pieces, windows

WINDOW, GRAM = 50, 4
#: Bits of the bitmap of repeated anchors: 8 MB whatever the input.
BITS = 1 << 26
#: Most hot anchors or windows that are broadcast, 16 bytes each.
HOT_ROWS = 1 << 17
#: Documents from which a window is hot, at least.
HOT_LEAST = 256
#: Windows of one bucket, about, and windows that a task gathers before it sends them: its memory does not grow with its rows.
FLUSH, SEND = 1 << 20, 1 << 18
#: Texts that are cut and sent on at once.
ROWS = 1024
LAST = (1 << 63) - 1

OUT = "n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept string"


def _anchors(words: np.ndarray, window: int) -> np.ndarray:
    """Least GRAM-gram hash of the window that starts at each word."""
    least, have, need = ngram_hashes(words, GRAM), 1, window - GRAM + 1
    while have < need:
        step = min(have, need - have)
        if len(least) <= step:
            return np.zeros(0, np.uint64)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    return least


def _first_per_hash(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct hashes with least id, greatest id and number of distinct ids."""
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    at = np.flatnonzero(new)
    other = new | np.concatenate([[True], ids[1:] != ids[:-1]])
    last = np.concatenate([at[1:], [len(hashes)]]) - 1
    return hashes[at], ids[at], ids[last], np.add.reduceat(other.astype(np.int64), at)


def _counted(rows: DataFrame, window: int, only: np.ndarray | None) -> DataFrame:
    """``hash, first, last, n`` of anchors, or of the windows whose anchor is in ``only``."""
    sent = None if only is None else rows.sparkSession.sparkContext.broadcast(only)

    def count(batches):
        some, size = [], 0

        def flush():
            h, a, z, n = _first_per_hash(*(np.concatenate(x) for x in zip(*some, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(a), pa.array(z), pa.array(n)], ["hash", "first", "last", "n"])

        for b in batches:
            ids = b.column(0).to_numpy()
            for p in pieces(b.column(2)):
                words = p.word_hashes()
                start, text = windows(p.offsets, window)
                keys = _anchors(words, window)[start]
                if sent is not None:
                    own = np.isin(keys, sent.value)
                    keys, text = ngram_hashes(words, window)[start[own]], text[own]
                else:
                    own = np.concatenate([[True], (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])]) if len(keys) else np.zeros(0, bool)
                    keys, text = keys[own], text[own]
                some.append((keys, ids[p.first + text]))
                size += len(keys)
                if size >= SEND:
                    yield flush()
                    some, size = [], 0
        if size:
            yield flush()

    return rows.mapInArrow(count, "hash long, first long, last long, n long").groupBy("hash").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


class _Hot:
    """Sorted hashes of hot windows and their first documents."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.first = hashes[order], first[order]
        own = np.zeros(1 << 22, bool)
        own[self.hashes & np.uint64((1 << 22) - 1)] = True
        self.bitmap = np.packbits(own, bitorder="little")

    def first_of(self, hashes: np.ndarray) -> np.ndarray:
        """First document of each hash, -1 for those that are not hot."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            maybe = np.flatnonzero(in_bitmap(self.bitmap, hashes))
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            real = self.hashes[at] == hashes[maybe]
            out[maybe[real]] = self.first[at[real]]
        return out

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        if len(self.hashes):
            maybe = np.flatnonzero(in_bitmap(self.bitmap, hashes))
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            out[maybe] = self.hashes[at] == hashes[maybe]
        return out


def _packed(hashes, docs, rows, places) -> bytes:
    """Columns one after the other, documents run-length coded."""
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (docs[1:] != docs[:-1])]))
    n = np.diff(np.concatenate([new, [len(rows)]]))
    head = np.array([len(hashes), len(new)], "<i8")
    return b"".join(x.tobytes() for x in (head, docs[new], rows[new], n.astype("<i4"), places.astype("<i4"), hashes))


def _unpacked(blob: bytes):
    n, m = np.frombuffer(blob, "<i8", 2)
    docs, rows = np.frombuffer(blob, "<i8", m, 16), np.frombuffer(blob, "<i8", m, 16 + 8 * m)
    counts = np.frombuffer(blob, "<i4", m, 16 + 16 * m)
    places = np.frombuffer(blob, "<i4", n, 16 + 20 * m)
    return np.frombuffer(blob, "<u8", n, 16 + 20 * m + 4 * n), np.repeat(docs, counts), np.repeat(rows, counts), places


def _by_bucket(batches):
    """Blobs of each bucket of a partition that is sorted by bucket."""
    now, blobs = None, []
    for b in batches:
        for k, x in zip(b.column("bucket").to_pylist(), b.column("blob"), strict=True):
            if blobs and k != now:
                yield now, blobs
                blobs = []
            now = k
            blobs.append(x.as_py())
    if blobs:
        yield now, blobs


def _dealt(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartition(max(8, buckets // 2), "bucket").sortWithinPartitions("bucket")


def _later_windows(rows: DataFrame, window: int, bitmap, hot, buckets: int) -> DataFrame:
    """``row, blob``: places of the windows, none of them hot, that also start in an earlier document."""
    shift = np.uint64(64 - buckets.bit_length() + 1)

    def candidates(batches):
        some, size = [], 0

        def flush():
            h, d, r, w = (np.concatenate(x) for x in zip(*some, strict=True))
            bucket = (h >> shift).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)):
                o = order[edges[k] : edges[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([_packed(h[o], d[o], r[o], w[o])], pa.binary())], ["bucket", "blob"])

        for b in batches:
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            for p in pieces(b.column(2)):
                words = p.word_hashes()
                start, text = windows(p.offsets, window)
                own = in_bitmap(bitmap.value, _anchors(words, window)[start])
                start, text = start[own], text[own]
                hashes = ngram_hashes(words, window)[start]
                own = ~hot.value.has(hashes)
                start, text, hashes = start[own], text[own], hashes[own]
                order = np.lexsort((hashes, text))  # one entry of a window in a document
                same = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
                own = np.ones(len(hashes), bool)
                own[order[1:][same]] = False
                start, text, hashes = start[own], text[own], hashes[own]
                some.append((hashes, ids[p.first + text], keys[p.first + text], start - p.offsets[text]))
                size += len(hashes)
                if size >= SEND:
                    yield from flush()
                    some, size = [], 0
        if size:
            yield from flush()

    def later(batches):
        for _, blobs in _by_bucket(batches):
            h, d, r, w = (np.concatenate(x) for x in zip(*map(_unpacked, blobs), strict=True))
            order = np.lexsort((d, h))
            h, d, r, w = h[order], d[order], r[order], w[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            own = d > d[first]
            d, r, w = d[own], r[own], w[own]
            if len(r):
                back = (r.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)
                order = np.lexsort((w, r, back))
                edges = np.searchsorted(back[order], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(edges)):
                    o = order[edges[k] : edges[k + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([_packed(np.zeros(0, "<u8"), d[o], r[o], w[o])], pa.binary())], ["bucket", "blob"])

    def gathered(batches):
        for _, blobs in _by_bucket(batches):
            parts = []
            for x in blobs:
                _, m = np.frombuffer(x, "<i8", 2)
                rows_, counts = np.frombuffer(x, "<i8", m, 16 + 8 * m), np.frombuffer(x, "<i4", m, 16 + 16 * m)
                parts.append((np.repeat(rows_, counts), np.frombuffer(x, "<i4", int(counts.sum()), 16 + 20 * m)))
            r, w = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((w, r))
            r, w = r[order], w[order]
            # runs of places that follow each other
            run = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (w[1:] > w[:-1] + 1)]))
            ends = np.concatenate([run[1:], [len(r)]]) - 1
            spans = np.stack([w[run], w[ends]], 1).astype("<i4")
            new = np.concatenate([np.flatnonzero(np.concatenate([[True], r[run][1:] != r[run][:-1]])), [len(run)]])
            yield pa.RecordBatch.from_arrays([pa.array(r[run][new[:-1]]), pa.array([spans[a:z].tobytes() for a, z in zip(new[:-1], new[1:], strict=True)], pa.binary())], ["row", "blob"])

    sent = _dealt(rows.mapInArrow(candidates, "bucket int, blob binary"), buckets).mapInArrow(later, "bucket int, blob binary")
    return _dealt(sent, buckets).mapInArrow(gathered, "row long, blob binary")


def _kept(piece: Piece, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts' remaining words, joined by one space."""
    words = np.flatnonzero(~gone)
    offsets = np.searchsorted(words, piece.offsets)
    lengths = piece.ends[words] - piece.starts[words] + 1
    lengths[offsets[1:][np.diff(offsets) > 0] - 1] -= 1
    ends = np.cumsum(lengths)
    begin = ends - lengths
    size = int(ends[-1]) if len(ends) else 0
    source = np.arange(size) + np.repeat(piece.starts[words] - begin, lengths)
    out = piece.data[np.minimum(source, max(len(piece.data) - 1, 0))] if size else np.zeros(0, np.uint8)
    gap = ends - 1
    gap = gap[(piece.starts[words] + lengths) > piece.ends[words]]
    out[gap] = 0x20
    return out, np.concatenate([[0], ends])[offsets] if len(ends) else np.zeros(len(offsets), np.int64)


def dedup(docs: DataFrame, keep: Sequence[str] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and OUT's: removed word intervals and the text that is left."""
    spark = docs.sparkSession
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(ids, text)
    rows = docs.select(ids.alias("doc"), key.alias("row"), text.alias("text"))

    anchors = stored(_counted(rows, window, None).filter("first < last").select("hash", "n"), "anchors")
    total, distinct = anchors.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    bitmap = spark.sparkContext.broadcast(slots_bitmap(anchors.select("hash"), BITS))
    hot_docs = max(HOT_LEAST, total * window // HOT_ROWS)
    hot_anchors = np.array(anchors.filter(F.col("n") > hot_docs).select("hash").toArrow()["hash"].to_numpy()).view(np.uint64)
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(hot_anchors):
        found = _counted(rows, window, np.sort(hot_anchors)).filter(F.col("n") > hot_docs).select("hash", "first").toArrow()
        hot = _Hot(found["hash"].to_numpy().view(np.uint64), found["first"].to_numpy())
    else:
        hot = _Hot(*empty)
    hot = spark.sparkContext.broadcast(hot)
    buckets = max(128, 1 << int(total * window // 2 // FLUSH).bit_length())
    later = stored(_later_windows(rows, window, bitmap, hot, buckets), "later-windows")
    touched = spark.sparkContext.broadcast(slots_bitmap(later.select("row"), BITS))
    drop(anchors)

    whole = docs.select(*keep, key.alias("__row"), ids.alias("__doc"), text.alias("__text"))
    schema = T.StructType([*whole.schema.fields[:-3], *T.StructType.fromDDL(OUT).fields])
    names, spans_type = schema.names, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def picked(batches, inside: bool):
        for b in batches:
            own = in_bitmap(touched.value, b.column(b.num_columns - (3 if inside else 4)).to_numpy().view(np.uint64))
            yield b if own.all() == inside and own.any() == inside else b.filter(pa.array(own == inside))

    def untouched(batches):
        yield from remove(picked(batches, False))

    def candidates(batches):
        yield from picked(batches, True)

    def remove(batches):
        for b in (whole_batch.slice(k, ROWS) for whole_batch in batches for k in range(0, whole_batch.num_rows, ROWS)):
            ids, blobs = b.column(b.num_columns - 3).to_numpy(), b.column(b.num_columns - 1)
            n, gone_n, spans, texts = [], [], [[]] * b.num_rows, []
            for p in pieces(b.column(b.num_columns - 2)):
                start, of = windows(p.offsets, window)
                marks = np.zeros(len(p.starts) + 1, np.int64)
                if len(start):
                    hashes = ngram_hashes(p.word_hashes(), window)
                    first = hot.value.first_of(hashes[start])
                    own = (first >= 0) & (first < ids[p.first + of])
                    for t in range(len(p)):
                        x = blobs[p.first + t].as_py()
                        if x is not None:  # the windows sent back, and their repeats in the same text
                            lo, hi = np.searchsorted(start, p.offsets[t : t + 2])
                            runs = np.frombuffer(x, "<i4").reshape(-1, 2)
                            mine = hashes[start[lo:hi]]
                            sent = np.concatenate([mine[a : z + 1] for a, z in runs])
                            own[lo:hi] |= np.isin(mine, sent)
                    np.add.at(marks, start[own], 1)
                    np.subtract.at(marks, start[own] + window, 1)
                gone = np.cumsum(marks[:-1]) > 0
                out, at = _kept(p, gone)
                at32 = at.astype(np.int64)
                texts.append(pa.LargeStringArray.from_buffers(len(p), pa.py_buffer(at32.tobytes()), pa.py_buffer(out.tobytes())))
                total = np.concatenate([[0], np.cumsum(gone)])
                n.append(np.diff(p.offsets))
                gone_n.append(total[p.offsets[1:]] - total[p.offsets[:-1]])
                for t in np.flatnonzero(gone_n[-1]):
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[p.offsets[t] : p.offsets[t + 1]].view(np.int8), [0]])))
                    spans[p.first + t] = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
            if n:
                left = pa.concat_arrays(texts).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns[:-4], pa.array(np.concatenate(n)), pa.array(np.concatenate(gone_n)), pa.array(spans, spans_type), left], names=names)

    alone = whole.withColumn("__blob", F.lit(None).cast("binary")).mapInArrow(untouched, schema)
    parts = max(8, buckets // 2)  # grows with the windows, so a task's share of the texts does not
    spans = later.select(F.col("row").alias("__later"), F.col("blob").alias("__blob")).repartition(parts, "__later").hint("merge")
    with_spans = whole.mapInArrow(candidates, whole.schema).repartition(parts, "__row").join(spans, F.col("__row") == F.col("__later"), "left").drop("__later")
    return alone.unionByName(with_spans.mapInArrow(remove, schema))
