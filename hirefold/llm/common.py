"""Shared pieces of the corpus operators: session limits for Arrow batches,
lineage cuts, input normalisation, batching and connected components."""

from __future__ import annotations

import math
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirefold.session import checkpoint_dir

# Rows and bytes of one Arrow batch sent to a Python worker: documents run to
# hundreds of KB, so the default of 10,000 rows would not bound its memory.
ARROW_ROWS = 2000
ARROW_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session and make sure that the shared
    checkpoint folder is registered."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    checkpoint_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: a reliable checkpoint in the shared spark.checkpoint.dir."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Steps:
    """Written tables between the rounds of an iterative operator, in the
    shared checkpoint folder. Unlike a checkpoint, a table that is read back
    has its own size, not the product of all it came from, so plans of many
    rounds stay plannable; and small tables are written by few tasks."""

    #: Rows that a task writes, where a step's number of rows is known to be bounded.
    ROWS = 10_000

    def __init__(self, spark: SparkSession, name: str):
        self._spark, self._n = spark, 0
        self._base = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, most: int | None = None) -> DataFrame:
        """``df``, written and read back. ``most``: it has no more rows."""
        path = f"{self._base}/{self._n}"
        self._n += 1
        tasks = None if most is None else max(1, math.ceil(most / self.ROWS))
        if tasks and tasks < int(self._spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(tasks)
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)


class Shared:
    """A broadcast object that tasks can load without this package on their
    path (it travels pickled by value)."""

    def __init__(self, spark: SparkSession, value):
        self._blob = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self):
        return {"_blob": self._blob, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self._blob.value)
        return self._value


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of any document table; null text is empty.
    Other columns, whatever their names, stay behind."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def free(docs: DataFrame, name: str) -> str:
    """``name``, or it with underscores until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(df: DataFrame, size: Column, per_piece: float) -> int:
    """How many pieces of about ``per_piece`` units the table holds (one
    aggregate over ``size``; at least one)."""
    total = df.select(F.sum(size).cast("double").alias("n")).first()["n"] or 0.0
    return max(1, math.ceil(total / per_piece))


def large(strings: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array without nulls."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    return strings.cast(pa.large_string()).fill_null("")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long):
    (node, root) with root the smallest node reachable, for every node that
    an edge names.

    Labels travel by minimum over neighbours and over parents and then jump
    (label of the label), so the number of rounds grows with the logarithm of
    the longest chain. Aggregates combine map-side; the joins read
    checkpointed tables, so a hub node's rows are split by AQE. Nothing is
    collected but the count of labels that still moved.
    """
    both = cut(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                 .select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("low")), "b")
        low = near.groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        own = cut(labels.join(low, "node").select("node", "label", F.least("label", "low").alias("next")))
        # A node's better label also serves its current parent.
        moved = cut(own.select("node", F.col("next").alias("label"))
                    .union(own.where("next < label").select(F.col("label").alias("node"), F.col("next").alias("label")))
                    .groupBy("node").agg(F.min("label").alias("label")))
        up = moved.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = cut(moved.join(up, "label").select("node", F.col("top").alias("label")))
        changed = (jumped.join(labels.withColumnRenamed("label", "was"), "node")
                   .where("label <> was").limit(1).count())
        labels = jumped
        if not changed:
            return labels.select("node", F.col("label").alias("root"))
