"""Tables that a task reads for its own partition of a scan.

``deal`` writes rows by the number of the partition they are for into the shared folder;
``own`` reads those of the running task.  It spares shuffling texts to their lookups: the
texts stay, and what is looked up comes to them.  Both scans of the texts must cut them
alike, as scans of the same files do; callers check that nothing is missing.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import shared_dir


def deal(rows: DataFrame, what: str) -> str:
    """Write ``rows``, each for the partition in its column ``part``; where they are."""
    path = shared_dir(rows.sparkSession, what)
    rows.repartition(F.col("part")).write.partitionBy("part").parquet(path)
    return path


def own(path: str) -> pa.Table | None:
    """The running task's rows; None if there are none."""
    store, root = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/part={TaskContext.get().partitionId()}", allow_not_found=True))
    names = sorted(x.path for x in found if x.path.endswith(".parquet"))
    return pa.concat_tables([pq.read_table(n, filesystem=store, partitioning=None) for n in names]) if names else None
