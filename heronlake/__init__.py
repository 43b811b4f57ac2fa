"""Spark-first analytics over agent session transcripts and training text.

Functions sent to executors are pickled by value: cluster nodes need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
