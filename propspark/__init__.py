"""Property-prediction data engine on Spark DataFrames and MLlib."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in tasks travel with the task, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
