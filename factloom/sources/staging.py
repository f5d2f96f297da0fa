"""Silver tables: intermediate results that several plans read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the folder that all executors share and read it back, so it
    is computed once and later plans start from it. A local session that names no
    such folder (``spark.checkpoint.dir``), as in tests, gets one of this process,
    which is deleted at its end; a session on a cluster has to name one."""
    spark = df.sparkSession
    folder, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        folder = _own[app]
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
