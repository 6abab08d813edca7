"""Python workers of a cluster get this package from the driver, so nothing need be installed on them."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Sends the package to the workers of the session, once an application."""
    spark = spark or SparkSession.active()
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="cloakwork-zip-")  # Spark's own file server hands it on
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/cloakwork_package.zip", "w") as z:
        for d, _, names in os.walk(top):
            for x in names:
                if x.endswith(".py"):
                    z.write(os.path.join(d, x), os.path.relpath(os.path.join(d, x), os.path.dirname(top)))
    spark.sparkContext.addPyFile(f"{folder}/cloakwork_package.zip")
    _shipped.add(app)
