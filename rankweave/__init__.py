"""rankweave: ranking-and-localization analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so a cluster needs no copy of it on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
