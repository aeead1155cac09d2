"""Operators of a training-data pipeline over documents and embeddings.

Functions that run in Python workers travel by value: executors need the
libraries, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
