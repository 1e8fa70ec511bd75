"""Operators for building training data out of large document tables."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel whole, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
