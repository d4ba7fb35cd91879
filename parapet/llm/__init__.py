"""Operators for training-data pipelines; nothing else in the library imports this package.

Functions of this package are sent to executors by value, so these need numpy, pandas and
pyarrow (op1 also the tokenizers library and its vocabulary file) but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
