"""Spark-native analytics for semantic 3D scene tables.

Every public function takes DataFrames and returns DataFrames.  All tables carry a leading
``scan_id`` column and no operator ever crosses scans, so many scans advance in one job.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run inside tasks travel with the plan, so executors need no installed copy.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
