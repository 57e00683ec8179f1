"""Market-feature tables on Spark: bars, alignment, features, labels, metrics, reports."""

import sys

from pyspark import cloudpickle

from .functions.over import Layout
from .session import build_session, checkpoint_root, cut_lineage, scratch_dir

# The grouped kernels travel to the executors by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Layout", "build_session", "checkpoint_root", "cut_lineage", "scratch_dir"]
