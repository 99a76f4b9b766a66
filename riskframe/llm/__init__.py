"""Training-data pipeline operators.

Nothing else in the library imports this package.  Functions that run inside Python
workers are shipped by value, so the workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
