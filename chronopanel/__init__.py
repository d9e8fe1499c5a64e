"""Panel analytics on Spark: entity x time tables as DataFrame-in, DataFrame-out functions."""

import sys

from pyspark import cloudpickle

# task functions travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
