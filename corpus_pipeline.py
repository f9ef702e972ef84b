"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

``STAGES`` lists (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of ``documents``.  ``run`` writes each stage's
result into the shared folder and reads it again.  No SQL expresses the stages;
``tests/llm`` holds them against brute force.

Cases common to all stages: an empty table stays empty; columns besides those of
``documents`` are dropped, whatever their names; texts are read whole.  Each stage's own cases are in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelforge.llm import decontaminate, jaccard, mixing, quality, substrings
from parcelforge.llm.storage import keyed_in, stored

#: Near copies share this much of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects; labels only train it.

    Rows are judged one by one by their texts: null and empty texts have a score too, null ids
    and repeated rows are judged like others, and a score equal to the threshold stays.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, keep=COLUMNS).filter("predicted = 1").select(COLUMNS)


def one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that with the least id (null ids come last; of equal ids that with the least hash of the row).

    Rows count, not ids: two rows of one id are near copies only if their texts are. Rows of
    a group that are equal in all columns are one document. Null, empty and word-less texts are no copies of anything and all stay.

    Rows that leave, or are repeated, are told by their hash; texts of rows outside a fixed-size bitmap of those
    hashes stay where they are read.
    """
    docs = docs.select(COLUMNS)
    key = F.xxhash64(*COLUMNS)
    rows = stored(jaccard.groups(docs, n=NEAR_WORDS, percent=NEAR_PERCENT, row_key=key).filter("n_shingles > 0").groupBy("group", "row_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "group-rows")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("m")).select(F.col("m.row_key").alias("kept_key"))
    judged = rows.join(first, F.col("row_key") == F.col("kept_key"), "left").select(F.col("row_key").alias("j_key"), F.col("kept_key").isNotNull().alias("stays"), "n")
    special = stored(judged.filter("not stays or n > 1").select("j_key", "stays"), "copies")
    perhaps = keyed_in(special.select("j_key"))
    met = docs.withColumn("__key", key).filter(perhaps("__key")).join(special.hint("merge"), F.col("__key") == F.col("j_key"), "left")
    alone = met.filter("stays is null").select(COLUMNS)
    once = met.filter("stays").dropDuplicates(["__key"]).select(COLUMNS)
    return docs.filter(~perhaps(key)).unionByName(alone).unionByName(once)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document has; texts without any are unchanged, texts of nothing else are dropped.

    Null ids come after all others and are equal; an equal id is not an earlier one, so repeated rows lose
    the same words; null, empty and short texts are unchanged.
    """
    out = substrings.dedup(docs, keep=COLUMNS).filter("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item.

    Rows are judged one by one: null ids and repeated rows like others; null and word-less texts stay;
    items with a null id count, null and word-less items have no window.
    """
    return decontaminate.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS).filter("n_hit = 0").select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The final mix: one row per emitted copy, with the columns of ``documents``, ``size`` and ``copy`` (1, 2).

    Every row has its own copies. Rows that are equal in all columns cannot be told apart, so
    they share the sum of their copies as evenly as it goes. Null sources are a source; null and
    empty texts have size 0 and are emitted like others; null ids are spread by their texts.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("__key"))
    taken = mixing.mix_sources(keyed, id_col="__key").groupBy(F.col("doc_id").alias("m_key")).agg(F.max("size").alias("size"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0")
    out = keyed.join(taken.hint("merge"), F.col("__key") == F.col("m_key"))
    own = F.expr("copies div rows") + (F.row_number().over(Window.partitionBy("__key").orderBy("__key")) <= F.col("copies") % F.col("rows")).cast("long")
    out = out.withColumn("own", own).filter("own > 0")
    return out.select(*COLUMNS, "size", F.explode(F.sequence(F.lit(1), F.col("own").cast("int"))).alias("copy"))


STAGES = [("quality", keep_good), ("jaccard", one_of_group), ("substrings", without_repeats), ("decontaminate", without_benchmark), ("mixing", mixed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
