"""Operators of a training-data pipeline: extraction, filters, duplicates, decontamination, mixing.

Each module holds one operator, made of functions from DataFrames to DataFrames. ``queries`` applies them to the
tables of a folder. Nothing outside this package imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
