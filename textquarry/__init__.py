"""Corpus indexing and search as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
