"""quotelake: quotation detection over transcripts and documents, built on Spark DataFrames."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions sent to Python workers travel by value, so executors need no installed package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
