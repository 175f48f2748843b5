"""Lineage cuts that survive lost executors.

``keep`` writes a frame as Parquet below ``spark.checkpoint.dir`` (a folder that the whole cluster shares) and reads it back, so
later stages start from files instead of recomputing. Only when the session names no folder does a fallback apply: a temporary
folder in local mode, the warehouse (shared by definition) on a cluster.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_fallback: dict[str, str] = {}
_shipped: set[str] = set()
_folders: list[str] = []  # temporary ones of the driver


def _folder() -> str:
    _folders.append(tempfile.mkdtemp(prefix="spreadgraph-"))
    return _folders[-1]


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] == "local":
        if "local" not in _fallback:
            _fallback["local"] = f"file://{_folder()}"
        return _fallback["local"]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone by now; the folder's owner cleans up then
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)
    for folder in _folders:
        shutil.rmtree(folder, ignore_errors=True)


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table. Its files go when the program ends, or by ``release``."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``keep`` returned and that nothing lazy reads any more."""
    for df in tables:
        if path := getattr(df, "_kept_at", None):
            _remove(df.sparkSession, path)
            _written[:] = [w for w in _written if w[1] != path]


@contextmanager
def scope() -> Iterator[None]:
    """Delete at the end all tables that ``keep`` wrote meanwhile: for callers that write or collect each result inside.

    Frames made inside are of no use afterwards, unless their rows were written elsewhere. Scopes nest; tables written before stay.
    """
    before = {path for _, path in _written}
    try:
        yield
    finally:
        for spark, path in [w for w in _written if w[1] not in before]:
            _remove(spark, path)
        _written[:] = [w for w in _written if w[1] in before]


#: Rows of an Arrow batch to and from Python workers: whole documents can be long, and a worker holds a batch at a time.
ARROW_ROWS = 256


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for jobs that were not submitted with it; keep Arrow batches small.

    The session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` falls to ARROW_ROWS and stays there, for lazy results read it when they
    run; a lower value stays as it is. Callers whose own Arrow work wants longer batches set it again once the results are written.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(_folder(), "spreadgraph_src.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)
