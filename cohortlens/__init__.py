"""Cohort analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the tasks by value, so it needn't be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
