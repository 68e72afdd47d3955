"""Operators of a training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Tasks get these modules' functions with the job, also where the package is not installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
