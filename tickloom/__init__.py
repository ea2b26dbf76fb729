"""tickloom: market-bar analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions travel to Python workers with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
