"""Spark-native analytics for trade bills, dictated deals and text corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: a cluster needs no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
