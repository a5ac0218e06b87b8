"""Embedding-table analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Kernels travel to executors by value, so the package does not have to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
