"""Mixing sources to target weights.

Words are counted per document and summed per source (map-side combined);
targets come from the weights, a source's target stops at ``most`` times its
size and the excess is shared again by weight until no target is above its
limit. The repetition rate of a source is target / size; each document is
taken floor(rate) times plus one Bernoulli copy with probability equal to
the fraction, drawn from a hash of the seed, the document id and its text, so
reruns agree and rows never need to meet.

Null text has size 0; the null source is a source of its own, last in order;
a source of size 0 has target 0 and its documents are taken 0 words (rate 0).
Rows that share an id, or have none (it draws as the text 'null'), draw by
their texts; rows that repeat both id and text draw alike. Very long texts are
counted and hashed in one pass each, in the JVM. An empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirefold.llm.common import free

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size), one row per
    source. Weights go round over the sources by code point, null last.

    Sharing the excess until none is above ends at target = min(limit,
    level * weight) with one level for all; sorted by limit / weight the
    level is the first that its source doesn't exceed; levels after it only
    fall, so it is the largest that fits. The windows without a partition run over one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                         ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", cycle).withColumn("limit", F.col("source_size") * most)
    by = [(F.col("limit").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*by).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("total", F.sum("source_size").over(everything))
         .withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
                     .cast("double") / F.sum("weight").over(after)))
    fits = F.col("level") * F.col("weight") <= F.col("limit").cast("double")
    s = s.withColumn("final", F.max(F.when(fits, F.col("level"))).over(everything))
    target = F.least(F.col("limit").cast("double"), F.col("final") * F.col("weight"))
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target,
    copies (how often the mix takes it), taken (words, repeats counted)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{source_col}`").cast("string").alias("source"),
                       word_count(F.col(f"`{text_col}`")).alias("size"), _digest(text_col).alias("text_md5"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    joined = rows.join(targets.withColumnRenamed("source", "__source"),
                       F.col("source").eqNullSafe(F.col("__source")), "left")
    return joined.select(
        "doc_id", "source", "size", "source_size", "target",
        _copies("doc_id", "text_md5", "target", "source_size", most, seed).alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def _digest(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def _copies(id_col: str, digest: str, target: str, source_size: str, most: int, seed: str) -> Column:
    """How often the mix takes a document."""
    rate = F.when(F.col(source_size) > 0, F.least(F.col(target) / F.col(source_size), F.lit(float(most)))).otherwise(0.0)
    name = F.coalesce(F.col(f"`{id_col}`").cast("long").cast("string"), F.lit("null"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name, F.lit(":"), F.col(digest))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    extra = F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    return (F.floor(rate) + extra).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: all columns of ``docs``, whatever their names, and
    ``mix_copy`` (1..n), one row per copy taken; a ``mix_copy`` that ``docs``
    already has is replaced."""
    docs = docs.drop("mix_copy")
    sizes = docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("source")).agg(
        F.sum(word_count(F.col(f"`{text_col}`"))).alias("source_size"))
    name, total, target, digest = (free(docs, x) for x in ("name", "total", "target", "text_md5"))
    targets = source_targets(sizes, weights, most).toDF(name, total, target)
    joined = docs.join(targets, F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(name)), "left")
    joined = joined.withColumn(digest, _digest(text_col))
    copies = _copies(id_col, digest, target, total, most, seed)
    return joined.where(copies > 0).select(*[F.col(f"`{c}`") for c in docs.columns],
                                           F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("mix_copy"))
