"""papyra: document ingestion and contract analytics expressed as Spark DataFrame plans.

Every operator is a function ``DataFrame -> DataFrame`` (or a small family of them); nothing in the core
collects data to the driver.  Sub-packages:

* ``sources``    file and table scans, sinks, table management
* ``operators``  registry, documents, extraction, serving, chat, events, signals
* ``functions``  column-expression helpers and the pluggable text-model / parser interfaces
* ``plans``      derived fixtures and the end-to-end batch ingestion run
* ``streaming``  Structured Streaming ingestion and change capture
"""

import sys as _sys

# Functions of this package that run inside Python workers (model stand-ins, parser and writer closures)
# are shipped by value, so executors do not need the package on their import path.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without by-value registration
    pass

from papyra.session import get_session, checkpoint_dir  # noqa: E402

__all__ = ["get_session", "checkpoint_dir"]
