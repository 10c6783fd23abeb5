"""Loomfield: DataFrame-to-DataFrame operators for document extraction,
catalog resolution, record hygiene and corpus preparation on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package that Spark runs in Python workers travel by value,
# so workers need no copy of the package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
