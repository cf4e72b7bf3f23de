"""Shared pieces: table access, scratch tables in the shared folder, Arrow maps."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_OWN_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()

#: The white space that separates words: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    if package.is_dir():  # else it was itself shipped
        folder = tempfile.mkdtemp(prefix="skysieve-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/skysieve_code.zip", "w") as out:
            for p in sorted(package.rglob("*.py")):
                out.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(f"{folder}/skysieve_code.zip")
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's own reader, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where it is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/skysieve-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir: executors do not see the driver's own folders")
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="skysieve-")
        atexit.register(shutil.rmtree, _OWN_FOLDERS[app], ignore_errors=True)
    return f"file://{_OWN_FOLDERS[app]}"


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again."""
        where = self.path(name)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out.scratch_path = where
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that ``keep`` returned and that nothing reads any more."""
        for df in frames:
            self.delete(df.scratch_path)

    def delete(self, where: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns freed memory to the system: workers live on between stages, and what they hoard counts for the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_rows(df: DataFrame, schema: T.StructType, per_batch: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``mapInArrow`` over columns: ``per_batch`` gives a list or array for each output column."""
    ship(df.sparkSession)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = per_batch(batch)
            cols = [
                x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=arrow.field(n).type)
                for n, x in ((n, out[n]) for n in names)
            ]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


def field(df: DataFrame, name: str, as_name: str | None = None) -> T.StructField:
    """The nullable field of a column, to carry a key of any type through a map."""
    return T.StructField(as_name or name, df.schema[name].dataType, True)
