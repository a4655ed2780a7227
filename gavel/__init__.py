"""Conversation analytics and corpus preparation on Spark.

Functions of this package that run in Python workers travel with the job, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
