"""Market-basket analytics and item-to-item recommendation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the functions that run inside tasks with the job: executors need numpy,
# pandas and pyarrow, but no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
