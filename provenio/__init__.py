"""Evidence analytics over documents, expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
