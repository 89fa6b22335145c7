"""Operators of a training-data pipeline; nothing else in the package imports this."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel with their code, so that workers need no copy of the
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
