"""Operators of a training-data pipeline.

Their Python functions travel to the executors with the jobs, so that only the
driver needs this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
