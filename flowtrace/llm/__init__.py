"""Operators of a training-data pipeline over document tables.

Nothing else in the library imports this subpackage. Functions that run in
Python workers are shipped by value, so executors need the listed libraries
but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
