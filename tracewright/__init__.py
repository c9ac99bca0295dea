"""Tracewright: trajectory-table quality analytics on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package that run in Python workers travel by value, so a
# cluster needs no copy of the package on its workers' import path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
