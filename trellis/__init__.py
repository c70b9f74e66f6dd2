"""Relational topology, sparse algebra and mesh analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that tasks run travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
