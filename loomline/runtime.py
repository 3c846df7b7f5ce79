"""Session helpers: reading tables, cutting lineage, internal column names."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: set[str] = set()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset and the master is in-process (tests), a temporary
    folder is set; on a cluster it has to be named by the session.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    present = context._jsc.sc().getCheckpointDir()
    if not folder:
        if present.isDefined():
            return present.get()
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomline-")
    if present.isEmpty():
        context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """A new folder name under the shared folder, for tables of this application; all of them are removed when Python ends."""
    root = f"{shared_folder(spark)}/loomline-{spark.sparkContext.applicationId}"
    if root not in _SCRATCH:
        _SCRATCH.add(root)
        atexit.register(_removed, spark, root)
    return f"{root}/{uuid.uuid4().hex}"


def _removed(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session is gone already; the folder is then the cluster's to clean
        pass


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it as a Parquet table in the shared folder, and go on from there.

    What comes after reads only the columns it needs, from compressed files
    that outlive any executor.
    """
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Names that no column of ``taken`` has, in any case of letters."""
    low, out = {x.lower() for x in taken}, []
    for name in wanted:
        while name.lower() in low:
            name = f"_{name}"
        low.add(name.lower())
        out.append(name)
    return out


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application; calls after the first do nothing."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="loomline-"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
