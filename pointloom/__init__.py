"""Spark-native registration of large collections of 3-D point clouds.

Every operator takes and returns DataFrames keyed by cloud or by cloud pair, so
one job registers many pairs at once.
"""

import sys

from pyspark import cloudpickle

# tasks get these functions by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
