"""Benchmark decontamination by winnowing.

A test window is ``WINDOW`` consecutive words of an item (an item of fewer words is one
window).  Its fingerprint is the least ``GRAM``-gram hash inside it; documents keep
the least ``GRAM``-gram hash of each sliding window likewise, so every shared span of
``WINDOW`` words has a shared fingerprint (windows shorter than ``WINDOW`` are their own
fingerprints).  A hit is extended from its fingerprint to the whole window: the rolling hash
of the ``WINDOW`` words around it is compared, which takes constant time a window where a
comparison word by word would repeat itself for each item that has the fingerprint.
The union of matching windows is the extended hit.

Test fingerprints of at most ``broadcast_limit`` windows are broadcast, and
documents are judged in one scan without a shuffle.  Beyond that, document windows pass
a bitmap of fixed size, and join the test windows by (fingerprint, hash).

Cases: null or word-less text has no words and no hits; null or word-less items have no
windows; items with a null id hit like others and are one item, listed last as null; an empty benchmark
hits nothing; repeated documents and null document ids are judged row by row, repeated
items count once by their ids; texts are read whole; other columns are passed on if asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import in_bitmap, slots_bitmap, stored
from .words import LOWER, NOT_ALNUM, Piece, ngram_hashes, pieces, windows

WINDOW, GRAM = 10, 5
#: Most test windows that are broadcast (24 bytes each).
BROADCAST_LIMIT = 1_000_000
#: Bits of the bitmap for larger benchmarks: 8 MB whatever the input.
BITS = 1 << 26

HIT = "n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<long>"


def _fingerprints(words: np.ndarray, length: int) -> np.ndarray:
    """Fingerprint of the window that starts at each word."""
    if length < WINDOW:
        return ngram_hashes(words, length)
    grams = ngram_hashes(words, GRAM)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    least = grams[:n].copy()
    for k in range(1, WINDOW - GRAM + 1):
        np.minimum(least, grams[k : k + n], out=least)
    return least


def test_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, length, fingerprint, hash`` of every window of the test items."""

    def of(batches):
        for b in batches:
            for p in pieces(b.column(1), NOT_ALNUM, LOWER):
                words, counts = p.word_hashes(), np.diff(p.offsets)
                rows = []
                for length in sorted({min(int(c), WINDOW) for c in counts if c}):
                    start, text = windows(p.offsets, length)
                    own = (counts[text] >= WINDOW) if length == WINDOW else (counts[text] == length)
                    start, text = start[own], text[own]
                    rows.append((b.column(0).take(pa.array(p.first + text)), np.full(len(start), length), _fingerprints(words, length)[start], ngram_hashes(words, length)[start]))
                for i, n, f, h in rows:
                    yield pa.RecordBatch.from_arrays([i, pa.array(n.astype(np.int32)), pa.array(f.view(np.int64)), pa.array(h.view(np.int64))], ["item_id", "length", "fingerprint", "hash"])

    return items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(of, "item_id long, length int, fingerprint long, hash long")


def _covered(piece: Piece, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which words of the piece lie in a window."""
    edge = np.bincount(starts, minlength=len(piece.starts) + 1) - np.bincount(starts + lengths, minlength=len(piece.starts) + 1)
    return np.cumsum(edge[: len(piece.starts)]) > 0


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


class _Index:
    """The broadcast form of the test windows: sorted hashes, with their items in rows."""

    def __init__(self, table: pa.Table):
        hashes = table["hash"].to_numpy().view(np.uint64)
        names = pc.unique(table["item_id"].combine_chunks()).to_pylist()
        self.names = sorted((x for x in names if x is not None)) + [None] * (None in names)
        known = table["item_id"].is_valid().to_numpy()
        self.ids = np.full(len(hashes), len(self.names) - 1)  # places in ``names``, the null id last
        self.ids[known] = np.searchsorted(np.array([x for x in self.names if x is not None], np.int64), table["item_id"].drop_null().to_numpy())
        order = np.lexsort((self.ids, hashes))
        self.ids, hashes = self.ids[order], hashes[order]
        self.hashes, first = np.unique(hashes, return_index=True)
        self.rows = np.concatenate([first, [len(hashes)]]).astype(np.int64)
        self.lengths = sorted(set(table["length"].to_pylist()))
        bits = 1 << max(16, int(16 * max(len(hashes), 1) - 1).bit_length())
        own = np.zeros(bits, bool)
        own[table["fingerprint"].to_numpy().view(np.uint64) & np.uint64(bits - 1)] = True
        self.bitmap = np.packbits(own, bitorder="little")

    def hits(self, piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, length, text and hash row of each window that occurs in a test item."""
        words, out = piece.word_hashes(), []
        for length in self.lengths:
            start, text = windows(piece.offsets, length)
            maybe = np.flatnonzero(in_bitmap(self.bitmap, _fingerprints(words, length)[start]))
            if len(maybe):
                start, text = start[maybe], text[maybe]
                hashes = ngram_hashes(words, length)[start]
                at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
                real = self.hashes[at] == hashes
                out.append((start[real], np.full(int(real.sum()), length), text[real], at[real]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _judged(batch: pa.RecordBatch, column: int, index: _Index) -> list[pa.Array]:
    n = batch.num_rows
    n_words, n_hit, spans, items = np.zeros(n, np.int64), np.zeros(n, np.int64), [[]] * n, [[]] * n
    for p in pieces(batch.column(column), NOT_ALNUM, LOWER):
        n_words[p.first : p.first + len(p)] = np.diff(p.offsets)
        starts, lengths, text, at = index.hits(p)
        if len(starts):
            flags = _covered(p, starts, lengths)
            for t in np.unique(text):
                own = flags[p.offsets[t] : p.offsets[t + 1]]
                n_hit[p.first + t], spans[p.first + t] = own.sum(), _runs(own)
                rows = np.unique(at[text == t])
                items[p.first + t] = [index.names[k] for k in np.unique(np.concatenate([index.ids[index.rows[r] : index.rows[r + 1]] for r in rows]))]
    return [pa.array(n_words), pa.array(n_hit), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.int64()))]


def mark(docs: DataFrame, items: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and HIT's."""
    found = test_windows(items)
    few = found.limit(broadcast_limit + 1).toArrow()
    if few.num_rows > broadcast_limit:
        return _mark_by_join(docs, found, keep, text_col)
    index = docs.sparkSession.sparkContext.broadcast(_Index(few))
    rows = docs.select(*keep, F.col(text_col).alias("__text"))

    def judge(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *_judged(b, b.num_columns - 1, index.value)], names=names)

    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(HIT).fields])
    names = schema.names
    return rows.mapInArrow(judge, schema)


def _mark_by_join(docs: DataFrame, found: DataFrame, keep: Sequence[str], text_col: str) -> DataFrame:
    """The same without a broadcast of the benchmark. Rows are told apart by a row number, as ids may repeat."""
    found = stored(found.distinct(), "test-windows")
    bitmap = docs.sparkSession.sparkContext.broadcast(slots_bitmap(found.select("fingerprint"), BITS))
    lengths = sorted(r.length for r in found.select("length").distinct().toLocalIterator())
    rows = stored(docs.select(*keep, F.col(text_col).alias("__text"), F.monotonically_increasing_id().alias("__row")), "judged-docs")

    def fingerprints(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for p in pieces(b.column(1), NOT_ALNUM, LOWER):
                words = p.word_hashes()
                n = np.diff(p.offsets)
                none = [pa.nulls(len(p), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(ids[p.first : p.first + len(p)]), pa.array(n), *none], ["row", "n", "length", "start", "fingerprint", "hash"])
                for length in lengths:
                    start, text = windows(p.offsets, length)
                    f = _fingerprints(words, length)[start]
                    maybe = np.flatnonzero(in_bitmap(bitmap.value, f))
                    start, text, f = start[maybe], text[maybe], f[maybe]
                    h = ngram_hashes(words, length)[start]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[p.first + text]), pa.array(n[text]), pa.array(np.full(len(start), length, np.int32)), pa.array((start - p.offsets[text]).astype(np.int32)), pa.array(f.view(np.int64)), pa.array(h.view(np.int64))], ["row", "n", "length", "start", "fingerprint", "hash"])

    cut = stored(rows.select(F.col("__row").alias("row"), F.coalesce("__text", F.lit("")).alias("text")).mapInArrow(fingerprints, "row long, n long, length int, start int, fingerprint long, hash long"), "fingerprints")
    hits = cut.filter(F.col("length").isNotNull()).join(found, ["fingerprint", "hash", "length"]).select("row", "start", (F.col("start") + F.col("length")).alias("end"), "item_id")
    # a span starts where no earlier window reaches
    places = hits.select("row", "start", "end").distinct()
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    places = places.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("span", F.sum("new").over(order))
    spans = places.groupBy("row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    ids = hits.groupBy("row").agg(F.transform(F.array_sort(F.collect_set(F.struct(F.col("item_id").isNull().alias("unnamed"), "item_id"))), lambda x: x["item_id"]).alias("items"))
    counts = cut.filter(F.col("length").isNull()).select("row", F.col("n").alias("n_words"))
    found = counts.join(spans, "row", "left").join(ids, "row", "left").select(F.col("row").alias("__r"), *(F.col(c).alias(f"__{c}") for c in ("n_words", "n_hit", "spans", "items")))
    out = rows.join(found, F.col("__row") == F.col("__r"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c[2:])
    return out.select(*keep, F.col("__n_words").alias("n_words"), F.coalesce("__n_hit", F.lit(0)).cast("long").alias("n_hit"), none("__spans", "array<struct<start:int,end:int>>"), none("__items", "array<long>"))
