"""Find and repair problems in tables at scale, with ordinary Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with them: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
