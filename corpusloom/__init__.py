"""Corpus processing and retrieval expressed as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The small Python helpers travel inside the tasks, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
