"""wayfold: geodata to travel-demand-model tables, as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle import cloudpickle

# Functions that run in Python workers travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
