"""Training-data operators: near duplicates, line and passage dedup, scoring, tokens, media.

Each module holds one operator with a general DataFrame interface and, below it, the
thin query that derives the contract columns.  Nothing else in the library imports
this subpackage.
"""

import sys

from pyspark import cloudpickle

# Python stages travel by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
