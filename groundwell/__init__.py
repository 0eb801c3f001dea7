"""Retrieval-context and conversation-memory operators expressed as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers carry their code along, so the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
