"""Session set-up and shipping of the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(name: str = "quarryleaf", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC, whose Python workers know this package; sizes of partitions are left to
    the cluster unless given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    return ship(builder.config(map=defaults | conf).getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers once per application, so that it need not be installed on them."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="ship-")  # read by the driver's own file server
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(os.path.join(folder, root.name), "zip", root.parent, root.name))
    return spark
