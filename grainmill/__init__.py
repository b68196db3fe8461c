"""grainmill: training-data preparation expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from grainmill.config import PrepConfig

# Executors need not have this package: functions of it travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["PrepConfig"]
