"""fanlens — audience-flow analytics on Spark DataFrames.

Input is an interaction log ``(uid, entity, ts)``: viewer ``uid`` interacted
with entity (streamer) ``entity`` at wall-clock time ``ts``.  Every operator is
a function from DataFrames to DataFrames; nothing is collected to the driver
except single scalars and the small fitted-model steps.
"""

import sys

from pyspark import cloudpickle

from fanlens.params import (  # noqa: F401
    FIXED,
    FLOWING,
    ROAMING,
    Params,
)

# functions that run in Python workers travel with the job: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
