"""Operators for training-data pipelines: tokens, quality, duplicates, licences, chats.

Functions that run inside Spark tasks live next to the operators. They are pickled by
value, so executors need not have this package installed.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
