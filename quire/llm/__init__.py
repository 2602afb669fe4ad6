"""Operators of a training-data pipeline over documents, pages and
conversations. Nothing outside this subpackage imports it; the driver
contract adds its queries only when it can be imported."""

import sys

from pyspark import cloudpickle

# Python steps travel with their jobs, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
