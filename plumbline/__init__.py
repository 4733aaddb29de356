"""plumbline: a PySpark-native engine for labelled collections and their embeddings.

Functions that run on executors are pickled by value, so a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
