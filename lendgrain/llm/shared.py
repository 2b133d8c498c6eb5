"""Folders and tables that driver and executors share, and objects a Python worker keeps."""

import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN_FOLDERS = {}
MADE = []  # folders made by new_folder and not dropped yet


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode without that setting, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        app = spark.sparkContext.applicationId
        if app not in OWN_FOLDERS:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            OWN_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="lendgrain-shared-")
        folder = OWN_FOLDERS[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, so that no two runs meet."""
    MADE.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, survives lost executors; removed with its last reference where
    spark.cleaner.referenceTracking.cleanCheckpoints is set, as it is in lendgrain.session."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, folder: str) -> DataFrame:
    """Written as Parquet and read back; for tables with wide columns, and where the planner should see the size."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder made by new_folder once everything read from it has been materialised."""
    from pyarrow import fs

    assert folder.startswith(shared_folder(spark) + "/"), folder
    system, path = fs.FileSystem.from_uri(folder)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_dir(path)
    if folder in MADE:
        MADE.remove(folder)


def drop_made_since(spark: SparkSession, before: int) -> None:
    """Removes the folders made since there were `before` of them, once what reads them has been written."""
    for folder in MADE[before:]:
        drop_folder(spark, folder)


def kept(name, make):
    """An object that a Python worker makes once and keeps over its tasks."""
    store = sys.modules.setdefault("lendgrain_kept_objects", types.ModuleType("lendgrain_kept_objects"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def own_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
