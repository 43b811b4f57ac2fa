"""Operators for building language-model training data on Spark.

Functions sent to executors are pickled by value, so a cluster needs neither this package
on its nodes nor a zip of it: only numpy, pyarrow and the libraries an operator names.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
