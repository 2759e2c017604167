"""Table profiling, exploration and preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
