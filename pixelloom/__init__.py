"""Raster analytics on Spark: images, matrices and lookup tables as relations."""

import sys

from pyspark import cloudpickle

# Python stages travel by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
