"""Retrieval and text processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole, so workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
