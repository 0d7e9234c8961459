"""hirefold: job-posting analytics as Spark DataFrame operators.

Every operator is a function from DataFrames (plus a rules object) to a
DataFrame. Nothing collects to the driver; shuffles happen only on posting id,
org key or company key.
"""

from hirefold.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
