"""Spark-native analytics for gridded flood-hazard data."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of the package travel to the executors as code, so nothing need be installed there.
register_pickle_by_value(sys.modules[__name__])
