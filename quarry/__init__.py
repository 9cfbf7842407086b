"""quarry: block analytics on Spark DataFrames - histograms, k-means, nearest neighbours, SVM, SVD and run logs.

Functions that run inside Python workers are pickled by value, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
