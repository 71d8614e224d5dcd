"""logspark: log-behaviour analytics as Spark DataFrame and Structured Streaming operators."""

import sys

from pyspark import cloudpickle

# the few Python functions that run in tasks travel with the plan, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
