"""Training-data operators: language, quality, sharding, scoring, dedup, extraction, tokens."""

import sys

from pyspark import cloudpickle

# Functions sent to workers carry their code, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
