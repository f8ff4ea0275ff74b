"""topicloom: topic analytics over short free-text records, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel with their jobs, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
