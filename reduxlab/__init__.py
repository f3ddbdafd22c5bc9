"""Spark jobs for studying what dimensionality reduction does to later steps."""

import sys

from pyspark import cloudpickle

# Worker code travels with the plan, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
