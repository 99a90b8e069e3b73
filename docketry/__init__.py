"""Docketry: court-docket analytics expressed as Spark DataFrame plans."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

__version__ = "0.1.0"

# Python workers import this package like any other where PYTHONPATH names its folder (or it is installed). Where only
# this process knows its place, its functions travel to the workers by value, or the package itself does (``ship``).
_HERE = Path(__file__).resolve().parent
_UNKNOWN = str(_HERE.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and _HERE.parent.name not in ("site-packages", "dist-packages")
_shipped: set[str] = set()

if _UNKNOWN:
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ship(spark) -> None:
    """Sends the package to the session's workers, once, if they can't import it."""
    context = spark.sparkContext
    if not _UNKNOWN or context.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(), "docketry.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_HERE.rglob("*.py")):
            z.write(p, str(p.relative_to(_HERE.parent)))
    context.addPyFile(path)  # the driver serves it to the executors
    if not _shipped:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    _shipped.add(context.applicationId)
