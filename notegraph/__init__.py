"""notegraph: keeps a large corpus of text notes chunked, embedded, linked and clean on Spark."""

import sys

from pyspark import cloudpickle

from notegraph.schema import SCHEMA_VERSION, Settings

# Tasks carry the few functions of this package they run, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["SCHEMA_VERSION", "Settings"]
