"""Labelled multidimensional signal analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
