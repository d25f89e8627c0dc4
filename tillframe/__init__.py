"""Retail analytics on Spark: cleaning, product matching, marts, models, search."""

import sys

from pyspark import cloudpickle

# Helpers used inside tasks travel with the job; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
