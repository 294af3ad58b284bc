"""cvframe: multi-label text-classification studies as Spark DataFrame jobs.

Subpackages
-----------
``sources``    readers and writers (CSV corpus, run records, LaTeX lines)
``functions``  column expressions (hash-keyed randomness, text, link functions)
``operators``  DataFrame -> DataFrame operators (splits, text, weights,
               scoring, metrics, run aggregation, significance, training)
``plans``      driver-table fixtures, the flagship evaluation plan and the
               query registry used by ``__spark_entry__``
``streaming``  incremental leaderboard over run records as they land
"""

from cvframe.schema import DIMS, LABEL_COLS  # noqa: F401
from cvframe.session import get_session, scratch_dir  # noqa: F401

try:  # ship this package's functions by value to Python workers (pandas UDFs)
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
