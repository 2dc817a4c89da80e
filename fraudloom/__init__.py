"""fraudloom: card-fraud and shop-order analytics written as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions sent to Python workers travel by value, so executors need no copy of
# this package.
register_pickle_by_value(sys.modules[__name__])
