"""Operators for preparing large text corpora (training-data pipelines).

Each module holds one operator as a function from DataFrames to a DataFrame;
``queries`` registers them. Task-side functions of this package are pickled
by value, so executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
