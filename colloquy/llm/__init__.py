"""Operators for training-data pipelines: ten corpus operators and their queries.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` depends on it.

Functions that run inside Spark tasks are shipped by value, so executors need
no copy of this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
