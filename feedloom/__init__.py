"""feedloom: full-text feeds from tables of captured web responses, on Spark."""

import sys

from pyspark import cloudpickle

# Ship the package's functions inside the tasks, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
