"""Annotation-benchmark analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from ratewise.session import build_session, shared_dir

# Functions that run in Python workers travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "shared_dir"]
