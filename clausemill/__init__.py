"""clausemill: a PySpark-native engine for collections of contracts and long documents."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Arrow functions travel to the executors inside the task, so that no executor
# needs this package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
