"""Time-series feature pipelines as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Ship the small UDF helpers with the job, so executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
