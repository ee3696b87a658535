"""Table operators for structured sparse learning, built on Spark DataFrames.

Every operator takes and returns DataFrames.  Independent problems share one
job: they are told apart by a ``problem_id`` key, never by a driver loop.

Functions that run in tasks are sent to the executors by value, so a cluster
needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
