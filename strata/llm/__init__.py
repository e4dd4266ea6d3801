"""Operators for preparing training data at scale.

Nothing else in the library imports this package. Its functions are shipped to the
executors by value, so that Python workers need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
