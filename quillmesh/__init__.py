"""quillmesh: Spark-native analytics over knowledge graphs of code, documents and tests."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions go to the executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
