"""Hidden-text analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
