"""Where intermediate files go, and how files appear whole or not at all."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder of its own machine.
    """
    shared = spark.conf.get(CHECKPOINT_DIR, None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"Set {CHECKPOINT_DIR} to a folder that all executors share.")
        shared = tempfile.mkdtemp(prefix="run-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- files of any file system that Spark can reach ----------------------------------------------------------------


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all it holds; nothing happens if there is none."""
    _files(spark, path).delete(_path(spark, path), True)


def listed(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    """``(name, seconds)`` of a folder's entries: when each was last changed; none if there is no such folder."""
    if not exists(spark, folder):
        return []
    found = _files(spark, folder).listStatus(_path(spark, folder))
    return [(entry.getPath().getName(), entry.getModificationTime() / 1000) for entry in found]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    out = _files(spark, path).create(_path(spark, path), False)
    try:
        out.write(text.encode())
    finally:
        out.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its content at once, unless there is one; of several callers one succeeds.

    The content goes to a file of another name first, which then gets the name. A file system's rename without
    overwriting is atomic where the file system says so (HDFS); on a local one a link is.
    """
    folder, _, name = path.rpartition("/")
    _files(spark, folder).mkdirs(_path(spark, folder))
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    write_text(spark, draft, text)
    try:
        files = _files(spark, path)
        if files.getUri().getScheme() == "file":
            os.link(_path(spark, draft).toUri().getPath(), _path(spark, path).toUri().getPath())
            return True
        gateway = spark.sparkContext._gateway
        options = gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = gateway.jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(_path(spark, draft), _path(spark, path), options)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception):
            return False
        raise
    finally:
        delete(spark, draft)


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Give a finished folder its name; there must be nothing of that name."""
    if exists(spark, path):
        raise FileExistsError(f"{path} exists already.")
    parent = path.rstrip("/").rpartition("/")[0]
    _files(spark, path).mkdirs(_path(spark, parent))
    if not _files(spark, staged).rename(_path(spark, staged), _path(spark, path)):
        raise OSError(f"{staged} could not be renamed to {path}.")
