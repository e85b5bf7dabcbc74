"""Operators for preparing training text.

Functions of this package travel to the tasks by value, so workers need not have it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
