"""vektorium: a PySpark-native engine for nearest-neighbour transaction scoring.

Functions that run on Python workers travel by value, so that executors need
no copy of this package on their own disks.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
