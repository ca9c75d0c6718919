"""Folders for intermediate tables that every executor can reach."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_own: dict[str, str] = {}  # application -> its temporary folder
_staged: dict[tuple[str, str], str] = {}
_made: dict[str, object] = {}  # path -> the JVM that can remove it
_seen: set[tuple[str, str, int]] = set()  # application, folder and cores for which it was tried


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith(("local[", "local-cluster["))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset, a ``local`` session gets a temporary folder, removed when the
    program ends. On a cluster a machine-local folder would be lost with its machine, so a
    missing setting raises instead, and so does one that names a folder of a local file system
    unless that is mounted on all machines, which a small job finds out.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "")
    if not base:
        if not _one_machine(master) or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = tempfile.mkdtemp(prefix="receivables-")
            atexit.register(shutil.rmtree, _own[application], ignore_errors=True)
        base = _own[application]
    elif not _one_machine(master) and _local(spark, base):
        _require_mounted(spark, base.rstrip("/"))
    return base.rstrip("/")


def remove(spark: SparkSession, path: str, empty_above: int = 0) -> None:
    """Removes a file or folder in any file system Spark knows, and up to ``empty_above`` of the
    folders above it that are empty then. What is not there is no error."""
    files = spark._jvm.org.apache.hadoop.fs
    place = files.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(place, True)
    _made.pop(path, None)
    for _ in range(empty_above):
        place = place.getParent()
        if not system.exists(place) or len(system.listStatus(place)):
            return
        system.delete(place, False)


def _local(spark: SparkSession, path: str) -> bool:
    """Whether the path lies in a file system of one machine, by its own or the default scheme."""
    scheme, named, _ = path.partition(":")
    if not named:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        scheme = place.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme()
    return scheme == "file"


def _require_mounted(spark: SparkSession, folder: str) -> None:
    """``RuntimeError`` unless the driver finds in ``folder`` what tasks on all cores write there.

    A machine without the mount keeps its tasks' files to itself, so that they are missing.
    Tried anew when the cluster has another number of cores, so that machines that came later
    are tried as well.
    """
    refusal = f"spark.checkpoint.dir names a local folder on a cluster: {folder}"
    try:
        cores = spark.sparkContext.defaultParallelism
        key = (spark.sparkContext.applicationId, folder, cores)
        if key in _seen:
            return
        path = f"{folder}/mounted-{uuid.uuid4().hex}"
        try:
            spark.range(0, cores, 1, cores).write.parquet(path)
            found = spark.read.schema("id LONG").parquet(path).count()
        finally:
            remove(spark, path)
    except Exception as error:
        raise RuntimeError(refusal) from error
    if found != cores:
        raise RuntimeError(f"{refusal}; the files of {cores - found} of {cores} tasks are missing")
    _seen.add(key)


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path not used before, inside the shared folder. Removed when the program ends, or
    before that by ``remove`` once nothing reads it any more."""
    path = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        if not _made:
            atexit.register(clean_up)
        _made[path] = jvm
    return path


def clean_up() -> None:
    """Removes the folders of this program; those that cannot be reached any more stay."""
    while _made:
        path, jvm = _made.popitem()
        with contextlib.suppress(Exception):
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(place, True)


def staged(spark: SparkSession, purpose: str, source: str, write: Callable[[str], None]) -> str:
    """The path of what ``write`` makes of ``source``; made once per application.

    ``write`` gets a new path. It is removed when the program ends.
    """
    key = (spark.sparkContext.applicationId, f"{purpose}:{source}")
    if key not in _staged:
        path = new_folder(spark, purpose)
        write(path)
        _staged[key] = path
    return _staged[key]
