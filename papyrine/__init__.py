"""Corpus analytics for scholarly records on Spark.

Every operator takes DataFrames and returns DataFrames; nothing holds a global session, and nothing is
collected to the driver. See README.md for a tour of the modules.
"""

import sys

from pyspark import cloudpickle

# Send the few Python functions to the executors by value, so that no package has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
