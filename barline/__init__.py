"""barline: time-ordered market analytics and training-data operators on Spark.

Python functions that run inside Spark tasks are pickled by value, so executors
need nothing but PySpark, pyarrow and numpy installed: no package upload and no
shared ``PYTHONPATH``.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
