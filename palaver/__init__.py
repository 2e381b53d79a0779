"""Chat event analytics as Spark DataFrame operators, batch and streaming."""

import sys

from pyspark import cloudpickle

# Functions that run on executors are sent along with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
