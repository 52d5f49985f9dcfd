"""Field-inspection analytics on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames; nothing in the package
runs an action on table data.  See README.md for the operator map.
"""

import sys

from pyspark import cloudpickle

from seamwatch.session import build_session

# Python tasks get the helpers of this package with their code, so executors
# need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
