"""Makes this package importable in the Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors, once per application. Operators with Python in their tasks call it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    target = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(_PACKAGE)}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
