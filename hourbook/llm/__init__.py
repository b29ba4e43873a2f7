"""Operators of a training-data pipeline.

One module per operator, each with its own general interface;
``queries`` registers one query per operator.  Nothing else in the library
imports this subpackage.  Functions that run inside tasks travel to the
executors by value, so a cluster needs no installed copy of it.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
