"""Operators that prepare training data. Nothing outside this folder imports them.

Functions of this package that run in tasks are sent to the executors with the job, so that the
executors need Spark and the Python libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
