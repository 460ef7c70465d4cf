"""Training-data pipeline operators (one module each) and their queries.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions of these modules travel to the executors by value, so the cluster
# needs no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
