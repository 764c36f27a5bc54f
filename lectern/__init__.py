"""lectern: hybrid retrieval and transcript analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so that a cluster needs no copy of
# this package on its machines.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
