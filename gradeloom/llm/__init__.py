"""Operators of a training-data pipeline: ten stages from text to tokens, as Spark jobs.

Functions of this package that run inside tasks are shipped by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
