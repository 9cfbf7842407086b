"""Operators for preparing training data; nothing else in the library imports this subpackage.

Functions of this library that run inside Python workers are pickled by value, so executors need
no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
