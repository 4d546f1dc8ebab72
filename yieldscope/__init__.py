"""Spark jobs that find which process parameters drive a target."""

import sys

from pyspark import cloudpickle

from yieldscope.sources.observations import Observations

# Functions of this package travel to the executors by value, so the package need
# not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Observations"]
