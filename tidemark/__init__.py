"""tidemark: geospatial, data-quality and model-monitoring operators for Spark tables."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions handed to Arrow operators travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
