"""ledgerlens: document retrieval and its evaluation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python functions that Spark sends to executors carry their code with them, so
# that the executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
