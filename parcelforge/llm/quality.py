"""Quality classifier by Bradley-Terry pairwise ranking.

Each text has FEATURES (shares of kinds of characters, repetition, word and sentence
shape; neither language, source nor id).  From preference pairs (a good and a bad
labelled text) weights are learnt by logistic loss on feature differences: P(a over
b) = sigmoid(w (x_a - x_b)).  Texts are ranked by w x.  The threshold is the quantile
of the training scores at the share of bad labels, and scores are
sigmoid(w x - threshold), so that 0.5 is the threshold.

Training uses all labelled documents that are not held out and all their pairs. Their features (128
bytes a document) are stored once; each Newton step is one pass over them: the sums over pairs
depend on the difference of two scores only, smoothly, so tasks add up counts, features and their products at the
nodes of a fixed grid of scores (Lagrange weights of six nodes, STEP apart), and the driver pairs the nodes, whose number
the input does not raise. Probabilities come within about 1e-9 of those of the single pairs for scores up to NEAR; beyond, nodes
lie further apart. The quantile is exact, selected by counts of 16 bits at a time. Scoring
is one scan without a shuffle.  Scores depend on the text alone.

Cases: null and empty texts have zero features and get a score too; null ids are scored, and are not held
out; a score equal to the threshold is 0.5 and predicts 1; without labels of both kinds all
scores are 0.5; repeated ids are scored row by row and train as one document (that of the least features); labels that
repeat an id count by their least value, null labels not at all; very long texts are read whole;
an empty table gives no rows; other columns are passed on if asked for, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import drop, stored
from .words import Piece, pieces

#: Distance of the grid's nodes, size of scores from which they lie further apart, and nodes that a score is spread over.
STEP, NEAR, SPREAD = 1 / 16, 64.0, 6
#: Rows added up at once, and labelled documents of one task, about.
BLOCK, ROWS = 1 << 16, 50_000
FEATURES = ("words", "word_bytes", "upper", "digits", "marks", "exclaims", "bars", "stops", "commas", "other_bytes", "lines", "same_as_before", "repeated", "long_words", "short_words", "marked_words")

_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_LETTER = _UPPER | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
_DIGIT = (_B >= 48) & (_B <= 57)
_MARK = np.isin(_B, list(b"#$%&*+/<=>@\\^_`{|}~[]"))


def _share(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[bounds[1:]] - total[bounds[:-1]]


def piece_features(p: Piece) -> np.ndarray:
    """One row of FEATURES for each text of the piece."""
    d, at, of = p.data, p.bounds, p.offsets
    n_bytes, n_words = np.maximum(np.diff(at), 1), np.diff(of)
    words = np.maximum(n_words, 1)
    letters = np.maximum(_share(_LETTER[d], at), 1)
    size = p.ends - p.starts
    hashes = p.word_hashes()
    text = np.repeat(np.arange(len(p)), n_words)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((hashes, text))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    marked = _MARK[d[p.ends - 1]] if len(size) else np.zeros(0, bool)
    columns = (
        np.log1p(n_words) / 8,
        _share_sum(size, of) / words / 8,
        _share(_UPPER[d], at) / letters,
        _share(_DIGIT[d], at) / n_bytes,
        np.sqrt(_share(_MARK[d], at) / n_bytes),
        np.sqrt(_share(d == 33, at) / n_bytes),
        np.sqrt(_share(d == 124, at) / n_bytes),
        np.minimum(_share(np.isin(d, (46, 63)), at) / words, 1),
        np.minimum(_share(np.isin(d, (44, 59, 58)), at) / words, 1),
        _share(d >= 128, at) / n_bytes,
        np.minimum(_share(d == 10, at) / words, 1),
        np.sqrt(_share(same, of) / words),
        _share(again, of) / words / np.log1p(n_words + 1),
        _share(size > 14, of) / words,
        _share(size <= 2, of) / words,
        _share(marked, of) / words,
    )
    out = np.stack(columns, 1).astype(np.float64)
    out[n_words == 0] = 0
    return out


def _share_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def features_of(column: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(FEATURES))), *(piece_features(p) for p in pieces(column))])


@dataclass
class Model:
    weights: np.ndarray
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_dot(x, self.weights) - self.threshold, -500, 500)))


def _dot(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores that do not depend on which rows are scored together."""
    out = np.zeros(len(x))
    for k in range(len(w)):
        out += x[:, k] * w[k]
    return out


def _node_sums(x: np.ndarray, good: np.ndarray, w: np.ndarray, sums: dict[int, np.ndarray]) -> None:
    """Adds count, features and their products of the rows to the nodes around their scores; keys are 2 * node + good."""
    s = _dot(x, w)
    size = np.maximum(np.abs(s), NEAR)
    u = np.where(np.abs(s) <= NEAR, s, np.sign(s) * NEAR * (1 + np.log(size / NEAR))) / STEP
    first = np.floor(u).astype(np.int64) - (SPREAD // 2 - 1)
    t = u - first
    share = np.stack([np.prod([(t - m) / (j - m) for m in range(SPREAD) if m != j], axis=0) for j in range(SPREAD)])
    cell = 2 * first + good
    order = np.argsort(cell, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0, [True]])) if len(x) else np.zeros(1, np.int64)
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        own = order[a:z]
        rows = x[own]
        added = share[:, own] @ np.concatenate([np.ones((len(own), 1)), rows, (rows[:, :, None] * rows[:, None, :]).reshape(len(own), -1)], axis=1)
        for j in range(SPREAD):
            key = int(cell[own[0]]) + 2 * j
            sums[key] = sums[key] + added[j] if key in sums else added[j]


def _pair_sums(sums: dict[int, np.ndarray], k: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of pairs of a good and a bad row, gradient and curvature of the sum of log(1 + exp(-w (x_i - x_j))) over them."""
    keys = np.array(sorted(sums), np.int64)
    u = (keys >> 1) * STEP
    at = np.where(np.abs(u) <= NEAR, u, np.sign(u) * NEAR * np.exp(np.maximum(np.abs(u) / NEAR - 1, 0)))
    table = np.array([sums[key] for key in keys.tolist()]).reshape(len(keys), -1)
    own = (keys & 1) == 1
    good, bad = table[own], table[~own]
    gradient, curve, pairs = np.zeros(k), np.zeros((k, k)), 0.0
    if not len(good) or not len(bad):
        return pairs, gradient, curve
    pairs = float(np.rint(good[:, 0].sum()) * np.rint(bad[:, 0].sum()))
    for a in range(0, len(good), 1024):
        g = good[a : a + 1024]
        miss = 1 / (1 + np.exp(np.clip(at[own][a : a + 1024, None] - at[~own][None, :], -500, 500)))  # probability that the bad text is preferred
        bend = miss * (1 - miss)
        gradient += (g[:, 0] @ miss) @ bad[:, 1 : k + 1] - (miss @ bad[:, 0]) @ g[:, 1 : k + 1]
        cross = g[:, 1 : k + 1].T @ (bend @ bad[:, 1 : k + 1])
        curve += ((bend @ bad[:, 0]) @ g[:, k + 1 :] + (g[:, 0] @ bend) @ bad[:, k + 1 :]).reshape(k, k) - cross - cross.T
    return pairs, gradient, curve


def _weights(sums_at: Callable[[np.ndarray], dict[int, np.ndarray]], k: int, penalty: float = 1e-3) -> np.ndarray | None:
    """Bradley-Terry weights by Newton steps on the mean loss + penalty / 2 |w|^2; none without rows of both kinds."""
    w = np.zeros(k)
    for _ in range(30):
        n, gradient, curve = _pair_sums(sums_at(w), k)
        if not n:
            return None
        step = np.linalg.solve(curve / n + penalty * np.eye(k), gradient / n + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray, penalty: float = 1e-3) -> Model:
    """Bradley-Terry weights, over all pairs of a good and a bad row, and the quantile threshold."""

    def sums_at(w):
        sums: dict[int, np.ndarray] = {}
        _node_sums(x, good, w, sums)
        return sums

    w = _weights(sums_at, x.shape[1], penalty)
    if w is None:
        return Model(np.zeros(x.shape[1]), 0.0)
    s = np.sort(_dot(x, w))
    k = int((~good).sum())
    return Model(w, float((s[k - 1] + s[min(k, len(s) - 1)]) / 2))


def _added(rows: DataFrame, w: np.ndarray) -> dict[int, np.ndarray]:
    """The sums at the nodes of all rows ``label, x``: a fixed number of nodes reaches the driver."""

    def of(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(w))
            for a in range(0, len(x), BLOCK):
                _node_sums(x[a : a + BLOCK], b.column(0).to_numpy()[a : a + BLOCK] == 1, w, sums)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["node", "sums"])

    def merged(batches):
        parts: dict[int, list[bytes]] = {}
        for b in batches:
            for key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts.setdefault(key, []).append(v)
        if parts:  # in an order of their own, so that reruns agree to the last bit
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([np.sum([np.frombuffer(v) for v in sorted(x)], axis=0).tobytes() for x in parts.values()], pa.binary())], ["node", "sums"])

    got = rows.select("label", "x").mapInArrow(of, "node long, sums binary").repartition(8, "node").mapInArrow(merged, "node long, sums binary").toArrow()
    return {k: np.frombuffer(v) for k, v in zip(got["node"].to_pylist(), got["sums"].to_pylist(), strict=True)}


def _threshold(rows: DataFrame, w: np.ndarray) -> float:
    """The middle between the scores on both sides of the share of bad labels, exactly: selected among integers in the order of the scores."""
    turned = np.int64(0x7FFFFFFFFFFFFFFF)

    def of(batches):
        for b in batches:
            bits = (_dot(b.column(1).flatten().to_numpy().reshape(-1, len(w)), w) + 0.0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(bits < 0, bits ^ turned, bits))], ["place"])

    places = stored(rows.select("label", "x").mapInArrow(of, "place long"), "quality-scores")
    rank = bad = rows.filter("label <> 1 or label is null").count()
    within, prefix = places, 0
    for shift in (48, 32, 16, 0):
        got = within.groupBy(F.shiftright("place", shift).alias("p")).count().toArrow()
        order = np.argsort(got["p"].to_numpy())
        p, up = got["p"].to_numpy()[order], np.cumsum(got["count"].to_numpy()[order])
        k = int(np.searchsorted(up, rank))
        rank, prefix = rank - (int(up[k - 1]) if k else 0), int(p[k])
        within = within.filter(F.shiftright("place", shift) == prefix)
    below, above = places.agg(F.count_if(F.col("place") <= prefix), F.min(F.when(F.col("place") > prefix, F.col("place")))).first()
    drop(places)
    pair = np.array([prefix, prefix if below > bad or above is None else above], np.int64)
    return float(np.where(pair < 0, pair ^ turned, pair).view(np.float64).mean())


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from all labelled documents that are not held out."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("l_id")).agg(F.min(label_col).cast("int").alias("label"))
    texts = docs.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def measure(batches):
        for b in batches:
            x = features_of(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["id", "x"])

    one = texts.mapInArrow(measure, "id long, x array<double>").groupBy("id").agg(F.min("x").alias("x")).join(known, F.col("id") == F.col("l_id")).select("id", "label", "x")
    tasks = 8 + known.count() // ROWS
    rows = stored(one.repartition(tasks, "id").sortWithinPartitions("id"), "quality-features")  # the same rows in the same order, whatever the partitions
    w = _weights(lambda w: _added(rows, w), len(FEATURES))
    model = Model(np.zeros(len(FEATURES)), 0.0) if w is None else Model(w, _threshold(rows, w))
    drop(rows)
    return model


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, ``score`` and ``predicted``."""
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    names = schema.names

    def of(batches):
        for b in batches:
            s = model.scores(features_of(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=names)

    return rows.mapInArrow(of, schema)
