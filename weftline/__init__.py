"""weftline: a Spark-native engine for tables of text, entities, relations and events.

Functions that run in Python workers are shipped by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
