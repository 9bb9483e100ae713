"""Point-in-time panel analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so only the driver needs the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
