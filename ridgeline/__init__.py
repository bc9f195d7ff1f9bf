"""Ridgeline: terrain-network and corpus analytics on PySpark.

Functions that run inside Python workers are pickled by value, so that a job
does not depend on this package being installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
