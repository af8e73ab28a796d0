"""Repository analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions of this package reach the workers by value; nothing is installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
