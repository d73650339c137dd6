"""Operators for training-data pipelines: language, lines, quality, URLs, copies, tokens, shards, leaks.

Functions that run in Python workers are shipped with the job (pickled by value), so executors
need no installed copy of this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
