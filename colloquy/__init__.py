"""Analytics over time-aligned conversations, and operators for training data, on Spark DataFrames.

Functions that run inside tasks are shipped by value, so executors need no copy
of this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
