"""Operators for preparing training data: search, near-dedup, mixing, sharding, scoring, packing."""

import sys

from pyspark import cloudpickle

# Functions of this package go to the executors whole, so that it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
