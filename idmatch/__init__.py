"""Identity matching over Spark tables: vectors, scores, thresholds, audits, feeds."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
