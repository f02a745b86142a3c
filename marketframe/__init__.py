"""marketframe: PySpark-native analytics for time-stamped posts and daily price bars.

Every public operator is ``DataFrame -> DataFrame`` (usable with ``DataFrame.transform``),
expressed with built-in Spark SQL functions and window/aggregate operators so that Catalyst
can push filters and prune columns and whole-stage codegen keeps the work in the JVM.
"""

import sys as _sys

# Functions of this package used inside UDFs (pandas UDFs, mapInPandas, predict_batch_udf) are
# shipped to the Python workers by value, so executors need not have the package installed.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: install the package on executors
    pass

from marketframe.session import build_session, ensure_session_defaults  # noqa: E402

__all__ = ["build_session", "ensure_session_defaults"]
