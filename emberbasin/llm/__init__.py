"""Operators of a training-data pipeline: packing, rules, sharding, duplicate removal, mixing, scoring, archives, fingerprints.

Functions that run inside tasks are pickled by value, so executors need numpy,
pyarrow and the libraries an operator names, but not this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
