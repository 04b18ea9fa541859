"""Operators for preparing language-model training data; nothing else in the library imports this folder."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors with their code, so these need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
