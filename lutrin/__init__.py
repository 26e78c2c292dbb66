"""Lutrin: corpus, retrieval and evaluation jobs written as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code: no copy of the package is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
