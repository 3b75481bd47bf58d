"""Operators of a training-data pipeline over documents and web pages.

Functions that run inside Spark's Python workers are shipped by value, so executors need no copy of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
