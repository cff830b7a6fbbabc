"""Data quality on Spark: profile, detect, score, gate, compare, repair, mask."""

import sys

from pyspark import cloudpickle

# Python functions used in tasks travel with their job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
