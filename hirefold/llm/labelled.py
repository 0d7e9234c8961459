"""Labelled training rows: never the held-out ids, bounded, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1 (a null id: not held out)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(rows: DataFrame, labels: DataFrame, label: str, most: int, seed: str = "fit") -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled rows that aren't
    held out, half of either class if there are enough, picked by a hash of
    the id (the bound of the fit; every row is scored). Ids with
    contradictory labels or texts keep each row; null labels are no labels."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
             .where("label in (0, 1)").where(~held_out(F.col("doc_id"))).distinct())
    draw = F.xxhash64(F.lit(seed), "doc_id")
    # One bounded top-k a class, before any text is read.
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(draw, "doc_id").limit(most // 2)
        picked = part if picked is None else picked.union(part)
    return rows.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label")  # at most ``most`` rows of 12 bytes
