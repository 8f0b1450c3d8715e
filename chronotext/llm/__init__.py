"""Operators for training corpora; nothing else in the library imports this package.

Their functions travel with the tasks, so that executors need not have the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
