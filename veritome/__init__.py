"""veritome: a PySpark-native analytics engine for legal and corporate text corpora."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: no node has to have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
