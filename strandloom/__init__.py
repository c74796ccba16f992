"""Strand-aware interval analytics and data preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions travel to the executors with their code, so these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
