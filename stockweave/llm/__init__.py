"""Operators for building training corpora; nothing else in the package imports this."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel whole: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
