"""Training-data operators.

Nothing else in the library imports this subpackage. Functions that run on executors travel
by value, so the package need not be installed on every machine of a cluster.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
