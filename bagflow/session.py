"""Make the package importable on workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the workers with addPyFile, once per application, unless PYTHONPATH already has its folder.

    Times are in UTC. Python gets batches of at most 2,000 rows, as rows may be whole documents.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _shipped or str(root.parent) in on_path:
        return spark
    target = Path(tempfile.mkdtemp(prefix="bagflow-")) / "bagflow.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir, in this application's own subfolder there.

    Where the setting is missing, a temporary folder of this machine serves with a local master; on a cluster it is an
    error, for executors can't read one another's disks.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-bagflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/bagflow-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
