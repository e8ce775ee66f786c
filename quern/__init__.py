"""Quern: retrieval and adaptation evaluation as declarative Spark plans."""

import sys

from pyspark import cloudpickle

# Functions travel to Python workers by value, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
