"""Spark-native privacy engine for tables of text."""

import sys

from pyspark import cloudpickle

# Functions travel to the workers by value, so executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
