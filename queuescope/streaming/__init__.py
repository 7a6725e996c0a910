"""Structured Streaming forms of the queue replay and of the as-of lookup at arrivals.

Functions that run inside tasks are pickled by value, so executors need pandas, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
