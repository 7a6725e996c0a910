"""Operators for preparing training text, and their queries.

Functions of this package that run inside tasks are pickled by value, so executors need numpy and
the named third-party modules, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
