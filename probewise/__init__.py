"""Embedding search and verification analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# functions used in tasks travel with the task, so executors need no copy of
# this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
