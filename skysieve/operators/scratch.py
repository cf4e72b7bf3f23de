"""Tables written to the shared folder between rounds of an iteration, which cuts lineage and outlives executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: dict[str, str] = {}
_NAMED: set[str] = set()


def _clear(jvm, where: str) -> None:  # noqa: ANN001
    """Deletes the application's tables when its driver ends; what cannot be reached by then stays."""
    try:
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone
        pass


def folder(df: DataFrame) -> str:
    """What ``spark.checkpoint.dir`` names; a temporary folder where it is unset and all runs on one machine."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        where = f"{named.rstrip('/')}/skysieve-tables-{app}"
        if where not in _NAMED:
            _NAMED.add(where)
            atexit.register(_clear, spark.sparkContext._jvm, where)
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir: executors do not see the driver's own folders")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="skysieve-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write and read again."""
    where = f"{folder(df)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
