"""Keyed energy-telemetry analytics as Spark DataFrame programs.

Every operator takes DataFrames and key columns, returns a DataFrame and leaves the
physical plan to Spark.  Series operators never put a whole key into one task: see
``gridloom.operators.series``.
"""

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel by value, so workers need not install the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
