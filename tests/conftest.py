import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="hirefold-test-ckpt-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


def one(spark, expr, **cols):
    """Evaluate a column expression over a one-row DataFrame."""
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)], schema=_schema(cols))
    return df.select(expr.alias("out")).collect()[0]["out"]


def _schema(cols):
    from pyspark.sql import types as T
    fields = []
    for k, v in cols.items():
        t = (T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int)
             else T.DoubleType() if isinstance(v, float) else T.StringType())
        fields.append(T.StructField(k, t, True))
    return T.StructType(fields)
