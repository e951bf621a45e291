"""Event-to-outcome studies on regular time series, and training-data operators, as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel whole, so that executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
