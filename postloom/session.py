"""Session helpers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path below the folder that driver and executors share, ``spark.checkpoint.dir``.

    Only where that is unset (tests on one machine) a folder of this machine is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shared-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once for each application.

    Spark's own file server hands the archive to executors.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent).as_posix())
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "postloom_package.zip")
    Path(path).write_bytes(raw.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
