"""Market-event analytics and operational-table jobs expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

from tidewater.session import build_session, release_scratch, scratch_path, table

__all__ = ["build_session", "release_scratch", "scratch_path", "table"]

# Functions that run in tasks travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
