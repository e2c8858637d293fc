"""Operators for preparing training data: formatting, dedup, tokens, models, search, audit, mixing.

Functions that run in Python tasks travel with the job, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
