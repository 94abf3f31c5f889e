"""Tessera: corpus indexing and hybrid search as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Task code travels by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
