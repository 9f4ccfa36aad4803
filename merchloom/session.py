"""Session helpers: code for the workers, lineage cuts and scratch tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_SCRATCH: dict[str, list[str]] = {}


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The archive is made by the driver and served by Spark, so workers need no path to the driver's
    files and a job may be started from any folder.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="merchloom-code-"), "merchloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.dirname(os.path.abspath(__file__))):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may do without: it uses a folder in its warehouse, never a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/merchloom-scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; nothing is ever overwritten there. See ``drop_scratch``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def scratch_count(spark: SparkSession) -> int:
    """Number of scratch paths handed out so far, as a mark for ``drop_scratch``."""
    return len(_SCRATCH.get(spark.sparkContext.applicationId, []))


def drop_scratch(spark: SparkSession, since: int = 0, until: int | None = None, read: Sequence[str] = ()) -> int:
    """Delete the scratch tables of this application, once nothing reads them any more; gives their number.

    ``since`` and ``until`` are marks: only paths handed out between them are deleted, and none that a file in ``read`` lies in.
    """
    held = _SCRATCH.get(spark.sparkContext.applicationId, [])
    paths, jvm, conf = held[since:until], spark._jvm, spark._jsc.hadoopConfiguration()
    names = {path.rsplit("/", 1)[-1] for path in paths if path}  # a name has a random part
    kept = {name for name in names if any(f"/{name}/" in file for file in read)}
    paths = [path if path.rsplit("/", 1)[-1] not in kept else "" for path in paths]
    for path in filter(None, paths):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    held[since:until] = ["" if path in paths else path for path in held[since:until]]  # marks stay valid
    return sum(map(bool, paths))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read again, so that columns are read one by one and sizes are known."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages see one fixed set of rows even if an executor is lost.

    Spark removes the files with the frame if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
