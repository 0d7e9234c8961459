"""Row numbers within groups that don't need a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirefold.session import checkpoint_dir


def _key(names: list[str], other: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(names, other, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def row_numbers(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... within each ``group`` by ``order``
    (nulls first; rows that tie are numbered in any order).

    The table is range-sorted, so a group of any size spreads over tasks;
    rows of one partition carry rising ids, and what earlier partitions hold
    of a group is added from one summary row per group and partition. The
    sorted rows are checkpointed, for the ids hold for that very sort only."""
    checkpoint_dir(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    at = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
          .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).checkpoint(eager=True))
    pieces = at.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    other = [f"_g{i}" for i in range(len(group))]
    pieces = pieces.select(*[F.col(g).alias(o) for g, o in zip(group, other, strict=True)], F.col("_part").alias("_p"), "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"))
    joined = at.join(pieces, _key(group, other) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(name, F.col("_at") - F.col("_first") + F.col("_earlier") + 1).select(*df.columns, name)
