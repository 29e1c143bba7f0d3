"""What operators need of a session: a shared folder for intermediate tables, and this package on the Python workers."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_swept: set[tuple[str, str]] = set()
#: By application, the staged tables that are not deleted yet and a weak reference to the file index of each.
_tables: dict[str, dict[str, JavaObject]] = {}


def ship_package(spark: SparkSession) -> None:
    """Adds a zip of the package's modules to the application once; called before any operator that runs Python."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = Path(__file__).resolve().parent
    zipped = Path(tempfile.mkdtemp(prefix="framelake-")) / "framelake.zip"
    with zipfile.ZipFile(zipped, "w") as out:
        for module in sorted(home.rglob("*.py")):
            out.write(module, module.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(zipped))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, a laptop) a temporary folder is set as the checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    kept = spark.sparkContext.getCheckpointDir()
    if not kept:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framelake-"))
        kept = spark.sparkContext.getCheckpointDir()
    return kept.rstrip("/")


def _app_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver ends, so staged tables do not pile up."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/framelake-{app}"
    if (app, path) not in _swept:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
        _swept.add((app, path))
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here and a lost executor loses nothing.

    ``reclaim`` deletes the table once no DataFrame can read it.
    """
    spark = df.sparkSession
    path = f"{_app_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    with contextlib.suppress(Py4JError):  # other readers of Parquet than Spark's usual one: the table stays until the driver ends
        index = table._jdf.queryExecution().analyzed().relation().location()  # every plan that reads the table holds this one object
        _tables.setdefault(spark.sparkContext.applicationId, {})[path] = spark._jvm.java.lang.ref.WeakReference(index)
    return table


def reclaim(spark: SparkSession) -> None:
    """Frees the disk that ended steps hold, which else stays taken until the driver happens to collect its garbage.

    Spark removes the shuffle files of queries that are over, and staged tables that no DataFrame can read are deleted.  An
    RDD taken of a DataFrame does not keep its tables.
    """
    gc.collect()  # DataFrames that Python has dropped hold their plans until then
    spark._jvm.System.gc()
    tables = _tables.get(spark.sparkContext.applicationId, {})
    for path in [path for path, index in list(tables.items()) if index.get() is None]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        tables.pop(path, None)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, after which the worker gives unused memory back while it waits for its next task."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release_memory()

    return wrapped


def settle(spark: SparkSession) -> None:
    """Lets the driver and every executor collect their garbage, so that disk and heaps taken by one step are given back before the next."""
    reclaim(spark)
    n = spark.sparkContext.defaultParallelism  # one task for each core
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def release_memory() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)
