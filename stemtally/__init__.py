"""Estimation and tabulation of hierarchical counts on Spark.

Sub-packages: ``catalog`` (histogram schemas as DataFrames), ``operators``
(DataFrame in, DataFrame out), ``sources`` (readers and writers), ``plans``
(whole jobs) and ``functions`` (column expressions and numeric helpers).
"""

import sys

from pyspark import cloudpickle

# Functions travel to the workers by value: no executor needs this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
