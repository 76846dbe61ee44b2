"""annalist: temporal-knowledge analytics on Spark DataFrames."""

from pyspark import cloudpickle as _cloudpickle

import sys as _sys

# Executors need not have this package on their path: its functions travel by value.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
