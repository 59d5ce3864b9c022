"""DataFrame operators for inventories, packing, audits, sync planning and corpus checks."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task functions travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
