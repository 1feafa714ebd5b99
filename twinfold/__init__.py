"""twinfold: a PySpark-native engine for entity resolution and near-duplicate analytics."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors by value: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
