"""Code-health analytics on Spark: a source tree is a DataFrame of files."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to Python workers carry their code: executors need no installation.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
