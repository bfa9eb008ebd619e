"""Operators for preparing training text and vectors, kept apart from the bar-panel library.

Task functions of this subpackage are pickled by value, so executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
