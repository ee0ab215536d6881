"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# The functions that run inside tasks travel with the tasks: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
