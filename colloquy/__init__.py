"""Transcript and meeting-library analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Helpers that run in tasks travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
