"""lexiclust: text-corpus analytics as Spark DataFrame operators."""

import sys as _sys

# Task-side code (pandas functions handed to applyInPandas / mapInPandas /
# pandas UDFs) is shipped by value, so executors need no installed copy of
# this package and no particular working directory.
try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
