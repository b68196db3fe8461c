"""Queries on the test tables, one per operator or job."""

import sys

from pyspark import cloudpickle

from workloads import dialogue, files, rows, shaping, stores, streams, tokens, transforms  # noqa: F401
from workloads.base import QUERIES, SQL

# Executors need not have these modules: functions of them travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["QUERIES", "SQL"]
