"""Customer-feedback analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
