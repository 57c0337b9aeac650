"""Measure, check and rewrite large document corpora as DataFrame work on Spark."""

from pyspark import cloudpickle as _cloudpickle

# Functions sent to Python workers travel with their code, so executors need no copy of
# this package on their path.
import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
