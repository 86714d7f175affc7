"""Spark-native building, scoring and curation of text benchmarks."""

import sys

from pyspark import cloudpickle

# Arrow functions travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
