"""Building and querying offline geocoding data sets on Spark.

Python functions are shipped to the executors by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
