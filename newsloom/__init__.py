"""newsloom: press-release corpus analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Send this package's functions to the executors with each job, so that they
# need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
