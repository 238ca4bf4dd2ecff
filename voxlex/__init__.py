"""voxlex: Spark-native encoding-model analytics.

Timed token tables become trailing text contexts, contexts become vectors
through a pluggable batch embedder, vectors are averaged per time frame, and
many response series are fitted at once with bootstrap ridge regression.
Everything is a DataFrame plan; Python runs only inside Arrow block jobs.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

from voxlex.session import get_session, checkpoint_dir

# Block jobs (mapInArrow / pandas UDFs) reference functions of this package.
# Pickling the package by value ships that code with each task, so executors
# need no installed copy and no path setup.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__all__ = ["get_session", "checkpoint_dir"]
