"""inferna — sentence-pair (NLI) data and model pipelines as Spark jobs."""

import sys as _sys

try:  # ship our functions to Python workers by value: no install on executors needed
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: rely on --py-files
    pass
