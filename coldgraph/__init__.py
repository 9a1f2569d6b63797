"""Analytics on graphs in which new nodes arrive without any edges, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
