"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Sources in code-point order (null last) get the weights in turn.  Their shares of
``total`` times all words are capped at ``most`` times a source's own words and the
excess is reshared by weight (closed form over the sorted caps, no iteration).  Each
document expects ``target / source words`` copies; within its source the
expectations are prefix-summed, one offset per source is added, and a copy is
emitted for each integer boundary that a document's interval crosses.

Scale: the prefix sum has two levels.  Rows fall into blocks (source, size class,
salt); a source of n rows has about sqrt(n) salts over all classes, so neither a
block nor a source's list of blocks grows faster than sqrt(n), and a source with a
third of all rows is spread like any other.  Ordering by size class stratifies
the sample: a source's words come nearer to its target than with a random order.

Targets take one row of some sixty bytes per source through one sorted window, which spills to disk;
nothing per document passes through it.

Cases: null text has no words and null source is a source of its own; a
source without words has target 0; repeated rows and repeated ids count as often as they occur, each row
for itself, and those of one id and size class share a block; null ids are spread by their texts;
ties of size are ordered by a hash of the id, the id, then the text's hash; very long texts are one document;
an empty table gives no rows; other columns are not touched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def hash_of(column: str, seed: int) -> Column:
    """32 bits of an MD5, which other engines can compute too."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: ``source, source_docs, source_size, target``. The windows run over one row per source."""
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("source_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    everything = Window.partitionBy()
    per = per.withColumns({"all": F.sum("source_size").over(everything) * F.lit(total), "cap": F.col("source_size") * F.lit(most)})
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    per = per.withColumns({
        "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    per = per.withColumn("capped", F.col("before") + F.col("cap") / F.col("weight") * F.col("rest") <= F.col("all"))
    per = per.withColumns({
        "level": (F.col("all") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)) / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything),
    })
    return per.select("source", "source_docs", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``."""
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).alias("spread")), "sizes")
    per = source_targets(sized, weights, total, most).withColumnRenamed("source", "own")
    rows = sized.join(per, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    rows = rows.withColumns({
        "class": F.length(F.bin("size")),
        "salt": (F.coalesce(F.pmod("spread", F.lit(1 << 32)), hash_of("doc_id", seed)) % F.ceil(F.sqrt("source_docs") / 4)).cast("int"),
    })
    block = ["source", "class", "salt"]
    counts = rows.groupBy(block).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*(F.col(c).alias(f"b_{c}") for c in block), before.alias("start"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(block).orderBy("size", hash_of("doc_id", seed), "doc_id", "spread")))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("class") == F.col("b_class")) & (F.col("salt") == F.col("b_salt")))
    offset = hash_of("source", seed + 1) / F.lit(float(1 << 32))
    each = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    at = F.col("start") + F.col("place")
    copies = (F.floor(at * each + offset) - F.floor((at - 1) * each + offset)).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
