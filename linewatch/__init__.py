"""linewatch: DataFrame operators for visual inspection lines."""

import sys

from pyspark import cloudpickle

# The small Python helpers travel with their tasks, so workers need no copy of
# the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
