"""Operators that prepare training data for language models.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""

import sys

from pyspark import cloudpickle

# Executors get this package's functions by value: they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules["tessera"])
