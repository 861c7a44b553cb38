"""Missing-data analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers whole, so that a driver may start in any folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
