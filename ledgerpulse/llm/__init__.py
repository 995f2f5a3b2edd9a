"""Operators for preparing training text. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Once, at import: functions of this package reach the workers by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
