"""Training-data operators: one module per operator, queries in ``registry``.

Functions of this subpackage are pickled by value, so Python workers need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
