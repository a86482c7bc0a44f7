"""Spark-native analytics for media and text provenance scoring."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Small helpers that run inside tasks travel with the job, so executors do not
# need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
