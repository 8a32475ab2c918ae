"""Training-data operators: scans, deduplication, sharding, mixing, packing.

Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their task, so executors do
# not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
