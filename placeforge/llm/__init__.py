"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it stands alone and can be
removed as a folder.  Python functions of this subpackage are shipped to the
executors by value, so executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
