"""Corpus and change-history analytics on Spark.

Functions that run in Python workers are pickled by value, so executors need not have this
package on their path, whatever folder they run in.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
