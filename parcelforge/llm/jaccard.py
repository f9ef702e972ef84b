"""N-gram Jaccard join with signature trees; groups of documents linked by similarity.

Two documents link when 100 * intersection >= percent * union of their sets of
``n``-word shingles.  Every link between different sets is accounted for:

1. Documents with equal sets are one node (64-bit set hash).  Shingle frequencies
   are counted in a sketch of fixed size over all documents.
2. Shingles are ordered by (sketched frequency, hash).  Nodes that link share one of their
   first ``size - ceil(percent * size / 100) + 1`` shingles; these are dealt
   out by hash in packed blocks.  Of a shingle's nodes those stay that have a partner of fitting
   size there: if a pair's first common shingle has places i and j, no more than
   min(size - i, size - j) shingles can be common.
3. In such a token group, nodes with sizes and bitmaps of their shingles are compared; larger sets have longer bitmaps, and all have in the later rounds.
   Large groups build a signature tree: its nodes hold OR-combined bitmaps, size
   ranges and component ranges, and a dual traversal prunes pairs of tree nodes whose
   greatest possible overlap is too small or that lie in one component already.
4. Two rounds propose for every node its most promising partner of another component;
   proposals are verified on the exact sets, and components follow after each round.
   So a group of k near copies costs about k verifications, not k * k / 2.
5. The last round takes the groups that still span several components.  Pairs of groups of at most LARGE
   nodes are verified one by one; nodes of larger ones meet with their sets in
   one task, which verifies pairs until they are linked through others, and returns links only.

Hot shingles: the sketch bounds the number of a shingle's nodes from above.  Where it exceeds ``limit`` (CHUNK, or
three times the mean counter on large inputs), the nodes are dealt out before they meet; the nodes of other
shingles are counted exactly where they meet.  Either way they are salted into cells of about
CHUNK nodes, at any size of the input; in the last round, cells of groups that still span several components are
paired.  So no task gets all nodes of a frequent shingle, and no link is lost.

Cases: A-Z are lower-cased; texts of fewer words than ``n`` have one shingle, the whole
sequence; null and word-less texts have no shingle and link with nothing; rows that
repeat an id are nodes of their own and may share a component; null ids stay null and
count as greatest; ties of likeness go to the greater hash; texts are read whole; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import components
from .storage import drop, in_bitmap, slots_bitmap, stored
from .substrings import _by_bucket
from .words import BLANKS, LOWER, Piece, mix, ngram_hashes, pieces, windows

SHINGLE, PERCENT = 4, 85
#: Counters of the frequency sketch (8 MB broadcast, whatever the input) and counters in one block.
SLOTS, SLOT_BLOCK = 1 << 21, 1 << 16
#: Bits of the bitmap that picks the sets to verify.
BITS = 1 << 23
#: Bytes of a node's bitmap, and the greatest set for which that many tell sets apart. Sets near a border have both bitmaps, so nodes that may link share a tier.
TIERS = ((64, 900), (256, 3600), (1024, 1 << 62))
FLUSH = 1 << 20
#: Nodes of a frequent token that meet in one cell.
CHUNK = 1024
LEAF, FAN, SMALL = 32, 8, 32
#: Nodes of a group up to which the last round verifies its pairs one by one.
LARGE = 32

_U = np.uint64


def piece_sets(p: Piece, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in order of text and hash; their texts; set sizes."""
    words, counts = p.word_hashes(), np.diff(p.offsets)
    start, text = windows(p.offsets, n)
    hashes = [ngram_hashes(words, n)[start]]
    texts = [text]
    for m in range(1, n):
        short = np.flatnonzero(counts == m)
        if len(short):
            hashes.append(ngram_hashes(words, m)[p.offsets[short]])
            texts.append(short)
    h, t = np.concatenate(hashes), np.concatenate(texts)
    order = np.argsort(h)
    order = order[np.argsort(t[order], kind="stable")]
    h, t = h[order], t[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    h, t = h[new], t[new]
    return h, t, np.bincount(t, minlength=len(p))


def _nodes(h: np.ndarray, t: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each whole set; 0 for empty sets."""
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h ^ _U(0x5851F42D4C957F2D)))])
    edge = np.concatenate([[0], np.cumsum(sizes)])
    out = mix(total[edge[1:]] - total[edge[:-1]] + sizes.astype(_U)) | _U(1)
    out[sizes == 0] = 0
    return out.view(np.int64)


def _bit_rows(h: np.ndarray, t: np.ndarray, n: int, width: int) -> np.ndarray:
    own = np.zeros((n, width * 8), bool)
    own[t, (h >> _U(20)) & _U(width * 8 - 1)] = True
    return np.packbits(own, axis=1, bitorder="little")


def _least(tier: int, percent: int) -> int:
    """Smallest set that may link with one which only this tier has."""
    return percent * TIERS[tier - 1][1] // 100 if tier else 0


def _bitmaps(h: np.ndarray, t: np.ndarray, sizes: np.ndarray, tier: int, percent: int) -> pa.Array:
    """Bitmaps of one tier; null for sets that are not in it."""
    width, most = TIERS[tier]
    inside = (sizes > 0) & (sizes <= most) & (sizes >= (_least(tier, percent) if tier > 1 else 0))  # the later rounds take the second tier for all small sets
    place = np.cumsum(inside) - 1
    own = inside[t]
    bits = _bit_rows(h[own], place[t[own]], int(inside.sum()), width)
    ends = np.concatenate([[0], np.cumsum(inside)]) * width
    valid = np.packbits(inside, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [pa.py_buffer(valid.tobytes()), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(bits.tobytes())])


def _summaries(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """``doc, key, node, n, b0, b1, b2`` (the bitmaps of its tiers) of every row, and per task blocks of counters (``doc`` null, ``node`` the block, ``b0`` the counters)."""

    def of(batches):
        counters = np.zeros(SLOTS, np.uint32)
        for b in batches:
            docs, keys = b.column(0), b.column(2)
            for p in pieces(b.column(1), BLANKS, LOWER):
                h, t, sizes = piece_sets(p, n)
                counters += np.bincount((h & _U(SLOTS - 1)).astype(np.int64), minlength=SLOTS).astype(np.uint32) if len(h) > SLOTS // 16 else 0
                if len(h) <= SLOTS // 16:
                    slot, c = np.unique(h & _U(SLOTS - 1), return_counts=True)
                    counters[slot] += c.astype(np.uint32)
                for a in range(0, len(p), 4096):
                    z = min(a + 4096, len(p))
                    lo, hi = np.searchsorted(t, [a, z])
                    bits = [_bitmaps(h[lo:hi], t[lo:hi] - a, sizes[a:z], k, percent) for k in range(len(TIERS))]
                    yield pa.RecordBatch.from_arrays([docs.slice(p.first + a, z - a), keys.slice(p.first + a, z - a), pa.array(_nodes(h[lo:hi], t[lo:hi] - a, sizes[a:z])), pa.array(sizes[a:z].astype(np.int32)), *bits, pa.array(np.zeros(z - a, bool))], names)
        if counters.any():
            blocks = counters.reshape(-1, SLOT_BLOCK)
            for k in range(len(blocks)):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([k], pa.int64()), pa.nulls(1, pa.int32()), pa.array([zlib.compress(blocks[k].tobytes(), 1)], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([True])], names)

    names = ["doc", "key", "node", "n", "b0", "b1", "b2", "sketch"]
    return rows.mapInArrow(of, "doc long, key long, node long, n int, b0 binary, b1 binary, b2 binary, sketch boolean")


def _sketch(summaries: DataFrame) -> np.ndarray:
    """Summed counters: a fixed number of blocks reaches the driver."""

    def add(batches):
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                y = np.frombuffer(zlib.decompress(x.as_py()), np.uint32).astype(np.uint64)
                own[k] = own[k] + y if k in own else y
        for k, y in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.minimum(y, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], ["node", "bitmap"])

    out = np.zeros((SLOTS // SLOT_BLOCK, SLOT_BLOCK), np.uint32)
    got = summaries.filter("sketch").select("node", F.col("b0").alias("bitmap")).repartition(8, "node").mapInArrow(add, "node long, bitmap binary").toArrow()
    for k, x in zip(got["node"].to_pylist(), got["bitmap"].to_pylist(), strict=True):
        out[k] = np.frombuffer(x, np.uint32)
    return out.ravel()


def _with_partner(token: np.ndarray, n: np.ndarray, most: np.ndarray, percent: int) -> np.ndarray:
    """Which entries, sorted by (token, n), have another one of their token with a size from percent of ``n`` to ``most``."""
    rank = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]])).astype(np.int64) << 32
    key = rank | n
    low = np.searchsorted(key, rank | ((percent * n + 99) // 100))
    high = np.searchsorted(key, rank | np.maximum(most, 0), "right")
    return high - low - (n <= most) > 0


def _limit(counters: np.ndarray) -> int:
    """Estimates up to this may be chance: such shingles' nodes are counted exactly."""
    return max(CHUNK, 3 * int(counters.mean()))


def _token_groups(rows: DataFrame, n: int, percent: int, sketch, limit: int, chunk: int, buckets: int) -> DataFrame:
    """``token, node, parts`` for prefix shingles of at least two nodes that may link; those of ``parts`` > 1 are hot and not looked at yet."""
    shift = _U(64 - buckets.bit_length() + 1)

    def prefixes(batches):
        some, size = [], 0

        def flush():
            h, v, m, at, hot = (np.concatenate(x) for x in zip(*some, strict=True))
            order = np.lexsort((v, h))
            h, v, m, at, hot = h[order], v[order], m[order], at[order], hot[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (v[1:] != v[:-1])  # a set of many copies counts once a task
            h, v, m, at, hot = h[new], v[new], m[new], at[new], hot[new]
            few, many = hot == 1, np.flatnonzero(hot > 1)
            columns = (((h[few] >> (shift - _U(32))) & _U(0xFFFFFFFF)).astype("<u4"), v[few], m[few].astype("<i4"), at[few].astype("<i4"))
            edges = np.searchsorted((h[few] >> shift).astype(np.int64), np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)):
                a, z = edges[k : k + 2]
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([b"".join(x[a:z].tobytes() for x in columns)], pa.binary())], ["bucket", "blob"])
            deal = (mix(h[many] ^ v[many].view(_U)) >> shift).astype(np.int64)
            many, deal = many[np.argsort(deal, kind="stable")], np.sort(deal)
            edges = np.searchsorted(deal, np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)):
                own = many[edges[k] : edges[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([buckets + int(k)], pa.int32()), pa.array([h[own].tobytes() + v[own].tobytes() + hot[own].astype("<i4").tobytes()], pa.binary())], ["bucket", "blob"])

        for b in batches:
            for p in pieces(b.column(1), BLANKS, LOWER):
                h, t, sizes = piece_sets(p, n)
                nodes = _nodes(h, t, sizes)
                often = sketch.value[(h & _U(SLOTS - 1)).astype(np.int64)]
                order = np.argsort((t.astype(np.int64) << 32) | often, kind="stable")
                first = np.cumsum(sizes) - sizes
                need = sizes - (percent * sizes + 99) // 100 + 1
                at = np.arange(len(h)) - first[t]
                own = at < need[t]
                some.append((h[order][own], nodes[t[own]], sizes[t[own]], at[own], np.where(often[order][own] > limit, -(-often[order][own].astype(np.int64) // chunk), 1)))
                size += int(own.sum())
                if size >= FLUSH:
                    yield from flush()
                    some, size = [], 0
        if size:
            yield from flush()

    def shared(batches):
        for bucket, blobs in _by_bucket(batches):
            if bucket < buckets:
                h, v, m, at = (np.concatenate([np.frombuffer(x, kind, len(x) // 20, len(x) // 20 * skip) for x in blobs]) for kind, skip in (("<u4", 0), ("<i8", 4), ("<i4", 12), ("<i4", 16)))
                order = np.lexsort((v, m, h))
                h, v, m, at = h[order], v[order], m[order].astype(np.int64), at[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (v[1:] != v[:-1])
                h, v, m, at = h[new], v[new], m[new], at[new]
                most = np.minimum((100 + percent) * (m - at) // percent - m, 100 * m // percent)
                for _ in range(2):
                    own = _with_partner(h, m, most, percent)
                    h, v, m, most = h[own], v[own], m[own], most[own]
                starts = np.flatnonzero(np.diff(h, prepend=h[:1] ^ 1)) if len(h) else np.zeros(0, np.int64)
                many = np.diff(starts, append=len(h))  # h is sorted
                token, parts = (bucket << 32) | h.astype(np.int64), np.repeat(-(-many // chunk), many).astype(np.int32)
            else:
                h, v, parts = (np.concatenate([np.frombuffer(x, kind, len(x) // 20, len(x) // 20 * skip) for x in blobs]) for kind, skip in (("<u8", 0), ("<i8", 8), ("<i4", 16)))
                order = np.lexsort((v, h))
                h, v, parts = h[order], v[order], parts[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (v[1:] != v[:-1])
                token, v, parts = (h[new] | _U(1 << 63)).view(np.int64), v[new], parts[new]
            for a in range(0, len(token), 1 << 16):
                z = a + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(token[a:z]), pa.array(v[a:z]), pa.array(parts[a:z])], ["token", "node", "parts"])

    dealt = rows.mapInArrow(prefixes, "bucket int, blob binary").repartition(max(8, buckets // 2), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(shared, "token long, node long, parts int")


class _Group:
    """Members of token groups: parallel arrays."""

    def __init__(self, node, root, n, bits, percent):
        self.node, self.root, self.n, self.bits, self.percent = node, root, n.astype(np.int64), bits, percent
        self.ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)

    def passing(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs (i, j): those in different components whose greatest possible overlap suffices, and their likeness by bitmaps."""
        a, b = self.n[i], self.n[j]
        own = (self.root[i] != self.root[j]) & (100 * np.minimum(a, b) >= self.percent * np.maximum(a, b))
        i, j = i[own], j[own]
        both = np.bitwise_count(self.bits[i] & self.bits[j]).sum(axis=1, dtype=np.int64)
        a, b, x, y = self.n[i], self.n[j], self.ones[i], self.ones[j]
        most = np.minimum(a - (x - both), b - (y - both))
        own = most * (100 + self.percent) >= self.percent * (a + b)
        return i[own], j[own], (both[own] / np.maximum(x[own] + y[own] - both[own], 1)).astype(np.float32)


def _small_pairs(g: _Group, edges: np.ndarray):
    """Candidate pairs of groups of at most SMALL members, for all groups at once."""
    sizes = np.diff(edges)
    group = np.repeat(np.arange(len(sizes)), sizes)
    small = (sizes <= SMALL)[group]
    for d in range(1, min(SMALL, int(sizes.max(initial=1)))):
        i = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
        if not len(i):
            break
        yield g.passing(i, i + d)


class _Tree:
    """Signature tree over members ordered by size: levels of OR bitmaps, size, surplus and component ranges."""

    def __init__(self, g: _Group, members: np.ndarray):
        self.g = g
        self.members = members[np.lexsort((g.bits[members, 0], g.n[members]))]
        m = self.members
        surplus = g.n[m] - g.ones[m]  # shingles beyond one a bit
        level = [g.bits[m], g.n[m], g.n[m], surplus, g.root[m], g.root[m]]
        folds = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
        self.levels, width = [], LEAF
        while True:
            at = np.arange(0, len(level[1]), width)
            level = [f.reduceat(x, at, axis=0) for f, x in zip(folds, level, strict=True)]
            self.levels.append(level)
            if len(at) == 1:
                break
            width = FAN

    def pairs(self):
        """Dual traversal from (root, root); yields passing pairs of members."""
        top = len(self.levels) - 1
        x = y = np.zeros(1, np.int64)
        for k in range(top, -1, -1):
            bits, low, high, surplus, r0, r1 = self.levels[k]
            keep = []
            for a in range(0, len(x), 1 << 14):
                i, j = x[a : a + (1 << 14)], y[a : a + (1 << 14)]
                fits = 100 * np.minimum(high[i], high[j]) >= self.g.percent * np.maximum(low[i], low[j])
                most = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64) + np.minimum(surplus[i], surplus[j])
                fits &= most * (100 + self.g.percent) >= self.g.percent * (low[i] + low[j])
                fits &= ~((r0[i] == r1[i]) & (r0[j] == r1[j]) & (r0[i] == r0[j]))
                keep.append(fits)
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            x, y = x[keep], y[keep]
            if k:
                below = len(self.levels[k - 1][1])
                i = (x[:, None, None] * FAN + np.arange(FAN)[None, :, None] + np.zeros((1, 1, FAN), np.int64)).ravel()
                j = (y[:, None, None] * FAN + np.arange(FAN)[None, None, :] + np.zeros((1, FAN, 1), np.int64)).ravel()
                own = (i <= j) & (i < below) & (j < below)
                x, y = i[own], j[own]
        n = len(self.members)
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            i, j = np.arange(a * LEAF, min(a * LEAF + LEAF, n)), np.arange(b * LEAF, min(b * LEAF + LEAF, n))
            i, j = np.repeat(i, len(j)), np.tile(j, len(i))
            own = i < j
            yield self.g.passing(self.members[i[own]], self.members[j[own]])


def _best(node: np.ndarray, partner: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((partner, like, node))
    node, partner, like = node[order], partner[order], like[order]
    last = np.concatenate([node[1:] != node[:-1], [True]])
    return node[last], partner[last], like[last]


def _proposals(members: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs ``a, b, like`` of ``token, cell, node, root, n, bitmap, tier`` rows, sorted by (tier, token, cell): each node's best partner.

    Or, if not ``best``: all pairs of groups up to LARGE, and of larger ones the nodes that have a partner, as ``a, token, cell``.
    """

    def of(batches):
        left = None
        out: list[tuple[np.ndarray, ...]] = []
        large: list[tuple[np.ndarray, ...]] = []
        size = 0

        def reduced(rows):
            a, b, s = (np.concatenate(x) for x in zip(*rows, strict=True))
            if best:
                return _best(a, b, s)
            order = np.lexsort((b, a))
            a, b, s = a[order], b[order], s[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            return a[new], b[new], s[new]

        def take(g, found):
            for i, j, s in found:
                if len(i):
                    a, b = g.node[i], g.node[j]
                    out.append((np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])) if best else (np.minimum(a, b), np.maximum(a, b), s))

        def work(rows):
            token, cell, node, root, n, bits = rows
            edges = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1]), [True]]))
            g = _Group(node, root, n, bits, percent)
            take(g, _small_pairs(g, edges))
            for k in np.flatnonzero(np.diff(edges) > SMALL):
                own = np.arange(edges[k], edges[k + 1])
                if (root[own] == root[own[0]]).all():
                    continue
                if best or len(own) <= LARGE:
                    take(g, _Tree(g, own).pairs())
                    if len(out) > 64:
                        out[:] = [reduced(out)]
                else:
                    open_ = np.zeros(len(node), bool)
                    for i, j, _ in _Tree(g, own).pairs():
                        open_[i] = open_[j] = True
                    large.append((node[open_], token[open_], cell[open_]))

        def send():
            if out:
                a, b, s = reduced(out)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())], names)
            if large:
                a, token, cell = (np.concatenate(x) for x in zip(*large, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.float32()), pa.array(token), pa.array(cell)], names)
            out.clear()
            large.clear()

        now = None
        for whole_batch in batches:
            tiers = whole_batch.column(6).to_numpy()
            for lo, hi in pairwise([0, *(np.flatnonzero(tiers[1:] != tiers[:-1]) + 1).tolist(), len(tiers)]):
                if lo == hi:
                    continue
                batch = whole_batch.slice(lo, hi - lo)
                rows = [batch.column(k).to_numpy() for k in range(5)]
                col = batch.column(5)
                at = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, 4 * col.offset)
                rows.append(np.frombuffer(col.buffers()[2], np.uint8, at[-1] - at[0], at[0]).reshape(len(col), -1).copy().view(_U))
                if left is not None and tiers[lo] != now:
                    work(left)
                    left = None
                now = tiers[lo]
                if left is not None:
                    rows = [np.concatenate(x) for x in zip(left, rows, strict=True)]
                token, cell = rows[0], rows[1]
                whole = len(token) - int(((token == token[-1]) & (cell == cell[-1])).sum())
                left = [x[whole:] for x in rows]
                if whole:
                    work([x[:whole] for x in rows])
                size = sum(len(x[0]) for x in (*out, *large))
                if size >= FLUSH:
                    yield from send()
        if left is not None:
            work(left)
        yield from send()

    names = ["a", "b", "like", "token", "cell"]
    return members.mapInArrow(of, "a long, b long, like float, token long, cell long")


def _sets(rows: DataFrame, n: int, nodes_in) -> DataFrame:
    """``s_node, set`` (sorted shingle hashes) of the nodes in the bitmap, once each."""

    def of(batches):
        for b in batches:
            sent = set()
            for p in pieces(b.column(1), BLANKS, LOWER):
                h, t, sizes = piece_sets(p, n)
                nodes = _nodes(h, t, sizes)
                edge = np.concatenate([[0], np.cumsum(sizes)])
                ids, blobs = [], []
                for i in np.flatnonzero(in_bitmap(nodes_in.value, nodes.view(_U)) & (sizes > 0)):
                    if nodes[i] not in sent:
                        sent.add(nodes[i])
                        ids.append(int(nodes[i]))
                        blobs.append(h[edge[i] : edge[i + 1]].tobytes())
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["s_node", "set"])

    return rows.mapInArrow(of, "s_node long, set binary").groupBy("s_node").agg(F.first("set").alias("set"))  # equal nodes have equal sets


def _only(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``sets`` without those that a bitmap of ``nodes`` rules out."""
    wanted = sets.sparkSession.sparkContext.broadcast(slots_bitmap(nodes, BITS))

    def of(batches):
        for b in batches:
            yield b.filter(pa.array(in_bitmap(wanted.value, b.column(0).to_numpy().view(_U))))

    return sets.mapInArrow(of, sets.schema)


def _links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())  # both are sorted and without repeats
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` that link."""
    sets = _only(sets, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    # b's set is dealt to each pair after a's; merge joins at every size, a node of many pairs is split by Spark's skew handling
    with_a = pairs.join(sets.hint("merge"), F.col("a") == F.col("s_node")).select("a", "b", F.col("set").alias("set_a"))
    with_b = with_a.join(sets.hint("merge"), F.col("b") == F.col("s_node")).select("a", "b", "set_a", F.col("set").alias("set_b"))

    def check(batches):
        for b in batches:
            own = pa.array([_links(np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U), percent) for x, y in zip(b.column(2), b.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(own), b.column(1).filter(own)], ["a", "b"])

    return with_b.mapInArrow(check, "a long, b long")


def _linked_in_groups(members: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` among ``token, cell, node, root, set`` rows: those that join components within a group, not all."""

    def of_group(rows):
        node, root = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:2])
        sets = [np.frombuffer(x[2], _U) for x in rows]
        n = np.array([len(x) for x in sets])
        width = next(w for w, most in TIERS if n.max() <= most)
        bits = _bit_rows(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), len(sets), width)
        above: dict[int, int] = {}

        def top(r: int) -> int:
            while above.get(r, r) != r:
                above[r] = above.get(above[r], above[r])
                r = above[r]
            return r

        for i, j, like in _Tree(_Group(node, root, n, bits.view(_U), percent), np.arange(len(node))).pairs():
            for k in np.argsort(-like, kind="stable"):
                x, y = int(i[k]), int(j[k])
                a, b = top(int(root[x])), top(int(root[y]))
                if a != b and _links(sets[x], sets[y], percent):
                    above[max(a, b)] = min(a, b)
                    yield int(node[x]), int(node[y])

    def of(batches):
        now, rows, out = None, [], []
        for batch in batches:
            for token, cell, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (token, cell) != now and rows:
                    out += of_group(rows)
                    rows = []
                now = token, cell
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        if rows and (out := list(of_group(rows))):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return members.mapInArrow(of, "a long, b long")


def _rooted(tokens: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``token, node, parts, root`` of groups that span several components."""
    if roots is None:
        return tokens.withColumn("root", F.col("node"))
    rooted = tokens.join(roots, "node", "left").withColumn("root", F.coalesce("root", F.col("node")))
    spans = rooted.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select(F.col("token").alias("o_token"))
    return rooted.join(spans, F.col("token") == F.col("o_token"), "left_semi")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT, row_key: Column | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``; with a ``row_key`` (long), also ``row_key`` and ``group``, which tells components of equal ids apart."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.lit(0).cast("long") if row_key is None else row_key).alias("key"))
    all_rows = stored(_summaries(rows, n, percent), "shingle-summaries")
    summary = all_rows.filter("not sketch")
    counters = _sketch(all_rows)
    sketch = spark.sparkContext.broadcast(counters)
    limit = _limit(counters)
    total = summary.agg(F.coalesce(F.sum(F.col("n").cast("double")), F.lit(0.0))).first()[0]
    prefix = total * (100 - percent) / 100
    buckets = max(128, 1 << int(prefix / FLUSH * 2).bit_length())
    tokens = stored(_token_groups(rows, n, percent, sketch, limit, CHUNK, buckets), "token-groups")
    features = stored(summary.filter("n > 0").groupBy("node").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), *(F.first(f"b{k}").alias(f"b{k}") for k in range(len(TIERS)))), "nodes")

    links, roots, sets = None, None, None
    for step in range(3):
        last, now = step == 2, _rooted(tokens, roots)
        salt = lambda seed: F.pmod(F.xxhash64("token", "node", F.lit(seed)), F.col("parts")).cast("long")
        if not last:
            now = now.withColumn("cell", salt(step))
        else:  # every cell of a hot group meets every other, and itself
            hot = now.filter("parts > 1").withColumns({"own": salt(step), "other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))})
            now = now.filter("parts = 1").withColumn("cell", F.lit(0).cast("long")).unionByName(hot.withColumn("cell", F.least("own", "other") * (1 << 31) + F.greatest("own", "other")).drop("own", "other"))
        shapes = _only(features.select("node", "n", *(f"b{k}" for k in range(len(TIERS)))), tokens.select("node"))
        used = range(1 if step else 0, len(TIERS))
        tiers = F.filter(F.array(*(F.struct(F.when(F.col("n") >= (_least(k, percent) if k > used[0] else 0), F.col(f"b{k}")).alias("bitmap"), F.lit(k).alias("tier")) for k in used)), lambda x: x["bitmap"].isNotNull())
        dealt = now.join(shapes.hint("merge"), "node").select("token", "cell", "node", "root", "n", F.explode(tiers).alias("b")).select("token", "cell", "node", "root", "n", "b.bitmap", "b.tier")
        dealt = dealt.repartition("token", "cell").sortWithinPartitions("tier", "token", "cell")
        found = stored(_proposals(dealt, percent, not last), "proposals")
        if last:
            pairs = found.filter("b is not null").select("a", "b").distinct()
        else:
            best = stored(found.groupBy("a").agg(F.max_by("b", F.struct("like", "b")).alias("b")), "partners")
            # nodes without a promising partner in another component are done, unless they are in a hot group
            kept = best.select(F.col("a").alias("k_node")).unionByName(now.filter("parts > 1").select(F.col("node").alias("k_node"))).distinct()
            fewer = stored(now.select("token", "node", "parts").join(kept, F.col("node") == F.col("k_node"), "left_semi"), "token-groups")
            drop(tokens)
            tokens = fewer
            pairs = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            if tokens.isEmpty():
                break
        if sets is None:
            alive = spark.sparkContext.broadcast(slots_bitmap(tokens.select("node"), BITS))
            sets = stored(_sets(rows, n, alive), "shingle-sets")
        new = _verified(pairs, sets, percent)
        if last:
            large = found.filter("b is null").select("token", "cell", F.col("a").alias("node"))
            large = large.join(_only(sets, large.select("node")).hint("merge"), F.col("node") == F.col("s_node")).drop("s_node")
            large = large.withColumn("root", F.col("node")) if roots is None else large.join(roots, "node", "left").withColumn("root", F.coalesce("root", F.col("node")))
            large = large.select("token", "cell", "node", "root", "set").repartition("token", "cell").sortWithinPartitions("token", "cell")
            new = new.unionByName(_linked_in_groups(large, percent))
        new = stored(new, "links")
        drop(found, None if last else best)
        links = new if links is None else links.unionByName(new)
        past, roots = roots, stored(components(links), "roots")
        drop(past)
    first = features.select("node", "doc")
    first = first.withColumn("root", F.col("node")) if roots is None else first.join(roots, "node", "left").withColumn("root", F.coalesce("root", F.col("node")))
    least = first.groupBy("root").agg(F.min("doc").alias("component"))
    first = stored(first.join(least, "root").select(F.col("node").alias("c_node"), "root", "component"), "components")
    drop(tokens, features, sets, roots)
    out = summary.select("doc", "key", "node", "n").join(first, F.col("node") == F.col("c_node"), "left")
    out = out.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"), F.col("key").alias("row_key"), F.coalesce("root", "node").alias("group"))
    return out if row_key is not None else out.drop("row_key", "group")
