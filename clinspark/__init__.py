"""Weak supervision and cohort building on coded records and notes, as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Python workers receive the few Arrow functions by value, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
