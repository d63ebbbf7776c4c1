"""Find, score and neutralise indirect prompt injection in large collections of untrusted content."""

import sys

from pyspark import cloudpickle

from thornwall.config import DEFAULT, ScanConfig

# Python workers get the few Arrow functions with the job and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DEFAULT", "ScanConfig"]
