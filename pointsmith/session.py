"""Session helpers: table loading, shipping the package to executors, shared checkpoints."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_PACKAGE = Path(__file__).resolve().parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a dataset folder (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for code that runs in Python workers."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="ship")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, in local mode only."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="checkpoints")
        atexit.register(shutil.rmtree, path, True)
        sc.setCheckpointDir(path)
    return path


#: Tables that `cut` has written and that are still there.
_cuts: list[str] = []


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder, by Hadoop's file systems; nothing happens if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _delete_cuts(spark: SparkSession) -> None:
    try:
        for path in filter(None, _cuts):
            delete_folder(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone by the end of the process: the folder is the cluster's to clear then
        pass


def scratch_name(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex}"


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed at the end of the application like the tables that are cut."""
    path = f"{shared_dir(spark).rstrip('/')}/{scratch_name(kind)}"
    _register(spark, path)
    return path


def _register(spark: SparkSession, path: str) -> None:
    if not _cuts:
        atexit.register(_delete_cuts, spark)
    _cuts.append(path)


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write df to a table in the shared folder and read it back: cuts lineage and survives lost executors.

    The tables are removed at the end of the application, or before by `drop_cuts`.
    """
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _register(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def cut_mark() -> int:
    """Where the list of tables stands, for drop_cuts."""
    return len(_cuts)


def drop_cuts(spark: SparkSession, since: int, but: int | None = None) -> None:
    """Remove the tables that were cut from `since` on, but that at place `but` if one is given."""
    for i in range(since, len(_cuts)):
        if i != but and _cuts[i]:
            delete_folder(spark, _cuts[i])
            _cuts[i] = ""
