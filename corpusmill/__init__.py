"""Spark jobs that prepare and evaluate text corpora for language-model training."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the task, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
