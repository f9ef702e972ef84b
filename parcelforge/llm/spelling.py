"""Spelling variant grouping: words that differ by one code point, by full neighbourhoods.

1. Words are runs of Latin letters, counted over all texts with map-side combine; those
   of at least ``least`` code points and two occurrences are the vocabulary.
2. Each word's whole neighbourhood is emitted: all distinct deletions, all
   replacements and all distinct insertions over the letters that the vocabulary has.  A
   candidate that equals a word of the vocabulary is near by construction; no distance is measured.
   Distinct by rule: within a run of one letter only its first place is deleted, or
   inserted at.  Candidates are hashed in numpy, and only those in a bitmap of the
   vocabulary become strings and go to the hash join, which decides by the strings themselves.
3. A word's form is its most frequent near word, if that occurs ``ratio`` times as
   often; roots follow forms by pointer jumping.  A chain of forms grows by ``ratio`` a step,
   so it has at most log10 of the greatest count steps, and the rounds are the logarithm of that.

Scale: a word of L letters has at most L + (2 L + 1) * 90 near words, so no key of a
join or group grows with the input.  The bitmap has 32 to 64 bits a word, at most
``MOST_BITS``; beyond 4 million words it lets more candidates through to the join, with the same result.

Cases: null and empty texts have no words; a null id is the empty text in a run's key
``<id>:<run>``; repeated rows and ids count as often as they occur; ties of the greatest count go to
the least word in code-point order; long texts are read whole; an empty table gives no rows;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, in_bitmap, slots_bitmap, stored
from .words import mix

#: A-Z, a-z and U+00C0 to U+00FF, so that a word is one byte a letter in Latin-1.
RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MOST_BITS = 1 << 27
#: Candidates hashed at once.
BLOCK = 1 << 20

_U = np.uint64
_STEP = _U(0xD1B54A32D192ED03)
_BACK = _U(pow(0xD1B54A32D192ED03, -1, 1 << 64))
_LETTER = mix(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, every: int = 31) -> DataFrame:
    """``word, n``.  A run whose crc32 of ``<id>:<run>`` is divisible by ``every`` loses one code point (0: none does)."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= least).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    word = F.col("run")
    if every:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % every == 0, cut).otherwise(word)
    counted = runs.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter("n >= 2")


def _matrices(column: pa.Array):
    """Words of a batch by length: their places, and a matrix of letters."""
    words = column.to_pylist()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        yield at, np.frombuffer("".join([words[i] for i in at]).encode("latin-1"), np.uint8).reshape(len(at), size)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, _U)
    np.multiply.accumulate(np.full(n - 1, _STEP, _U), out=out[1:])
    return out


def _key(sums: np.ndarray, size: int) -> np.ndarray:
    return mix(sums + _U(size))


def _swapped(h: np.ndarray) -> np.ndarray:
    return (h >> _U(32)) | (h << _U(32))


def _word_keys(batches):
    """Both bitmap keys of every word."""
    for b in batches:
        for _, m in _matrices(b.column(0)):
            h = _key((_LETTER[m] * _powers(m.shape[1])).sum(1), m.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h, _swapped(h)]).view(np.int64))], ["key"])


def _neighbourhood(m: np.ndarray, letters: np.ndarray):
    """All distinct one-letter changes of the words ``m`` (equal lengths): ``keys, size, build`` per kind of change.

    ``build(flat places in keys)`` gives the words' rows and the changed words' letters.
    """
    n, size = m.shape
    up = _powers(size + 1)
    part = np.zeros((n, size + 1), _U)
    np.cumsum(_LETTER[m] * up[:-1], axis=1, out=part[:, 1:])
    total = part[:, -1:]
    first = np.ones((n, size), bool)  # of a run of one letter
    first[:, 1:] = m[:, 1:] != m[:, :-1]
    columns = np.arange(size + 1)

    def deleted(at):
        w, i = np.divmod(at, size)
        return w, m[w[:, None], np.arange(size - 1) + (np.arange(size - 1) >= i[:, None])]

    def replaced(at):
        w, rest = np.divmod(at, size * len(letters))
        i, a = np.divmod(rest, len(letters))
        out = m[w]
        out[np.arange(len(w)), i] = letters[a]
        return w, out

    def inserted(at):
        w, rest = np.divmod(at, (size + 1) * len(letters))
        i, a = np.divmod(rest, len(letters))
        out = m[w[:, None], np.minimum(columns - (columns > i[:, None]), size - 1)]
        out[np.arange(len(w)), i] = letters[a]
        return w, out

    own = _LETTER[letters]
    yield _key(part[:, :-1] + (total - part[:, 1:]) * _BACK, size - 1), first, deleted
    other = m[:, :, None] != letters
    yield _key((total - _LETTER[m] * up[:-1])[:, :, None] + (own * up[:-1, None]), size), other, replaced
    new = np.ones((n, size + 1, len(letters)), bool)  # not after the same letter: that is the insertion one place before
    new[:, 1:] = other
    yield _key((part + (total - part) * _STEP)[:, :, None] + (own * up[:, None]), size + 1), new, inserted


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, near, near_n`` for all pairs of the table ``word, n`` that differ by exactly one inserted, deleted or replaced letter."""
    spark = words.sparkSession
    size = words.count()
    found = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()  # at most 90 letters
    letters = np.array(sorted(ord(r.c) for r in found if r.c), np.uint8)
    bits = min(MOST_BITS, max(1 << 16, 1 << (32 * size).bit_length()))
    bitmap = spark.sparkContext.broadcast(slots_bitmap(words.select("word").mapInArrow(_word_keys, "key long"), bits))

    def candidates(batches):
        for b in batches:
            for at, m in _matrices(b.column(0)):
                step = max(1, BLOCK // ((m.shape[1] + 1) * max(1, len(letters))))
                for k in range(0, len(at), step):
                    part, places = m[k : k + step], at[k : k + step]
                    for keys, distinct, build in _neighbourhood(part, letters):
                        keys, some = keys.ravel(), np.flatnonzero(distinct.ravel())
                        some = some[in_bitmap(bitmap.value, keys[some])]
                        some = some[in_bitmap(bitmap.value, _swapped(keys[some]))]
                        if len(some):
                            w, changed = build(some)
                            text, n = changed.tobytes().decode("latin-1"), changed.shape[1]
                            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places[w])), pa.array([text[i : i + n] for i in range(0, len(text), n)], pa.string())], ["word", "near"])

    pairs = words.select("word").repartition(max(8, size // 50_000), "word").mapInArrow(candidates, "word string, near string")
    return pairs.join(words.select(F.col("word").alias("v"), F.col("n").alias("near_n")), F.col("near") == F.col("v")).drop("v")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: each round doubles the steps that are followed."""
    at = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = at.select(F.col("word").alias("w"), F.col("root").alias("next"))
        joined = at.join(step, F.col("root") == F.col("w"), "left")
        if joined.filter("next is not null").isEmpty():
            return at
        past, at = at, stored(joined.select("word", F.coalesce("next", "root").alias("root")), "forms")
        drop(past)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, every: int = 31, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the vocabulary."""
    words = stored(vocabulary(docs, id_col, text_col, least, every), "vocabulary")
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    best = best.select(F.col("word").alias("b_word"), "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    form = F.col("near_n") >= ratio * F.col("n")
    judged = words.join(best, F.col("word") == F.col("b_word"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("near")).alias("form"), F.when(form, F.col("near_n")).alias("form_n"))
    judged = stored(judged, "forms-judged")
    roots = _roots(judged.filter("form is not null")).select(F.col("word").alias("r_word"), "root")
    return judged.join(roots, F.col("word") == F.col("r_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
