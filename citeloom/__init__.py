"""Spark jobs for a scholarly-publication corpus."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so that the package need not be installed on every worker.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
