"""Session settings and shared working folders."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application; operators that need it call this."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="loglattice-")
    atexit.register(shutil.rmtree, folder, True)
    packed = os.path.join(folder, "loglattice.zip")
    with zipfile.ZipFile(packed, "w") as z:
        for inside, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(inside, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(packed)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only when the cluster names none and the master is local (tests) is a temporary folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="loglattice-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], True)
    return _LOCAL_DIRS[app]


def _delete(sc, paths: set[str]) -> None:
    """Deletes intermediate tables; a later run never needs them."""
    for path in sorted(paths):
        try:
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may have been stopped before
            pass


_WORK: dict[str, set[str]] = {}
_SCRATCH: list[set[str]] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed at the end of the driver, of the ``scratch`` around it, or by ``discard``."""
    path = f"{shared_dir(spark)}/loglattice/{name}-{uuid.uuid4().hex[:12]}"
    sc = spark.sparkContext
    if sc.applicationId not in _WORK:
        _WORK[sc.applicationId] = set()
        atexit.register(_delete, sc, _WORK[sc.applicationId])
    _WORK[sc.applicationId].add(path)
    for held in _SCRATCH:
        held.add(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables that nothing will read again."""
    _delete(spark.sparkContext, set(paths))
    for held in (_WORK.get(spark.sparkContext.applicationId, set()), *_SCRATCH):
        held.difference_update(paths)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the intermediate tables made within it: results have to be written or collected before.

    For drivers that run for long; others delete theirs when they end.
    """
    held: set[str] = set()
    _SCRATCH.append(held)
    try:
        yield
    finally:
        _SCRATCH.remove(held)
        discard(spark, *held)


def materialised(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df``, written once to the shared folder and read back, and its path: lineage is cut and survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    return materialised(df, name)[0]


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names, based on ``names``, that clash with none of ``taken`` (whatever their case)."""
    low, out = {t.lower() for t in taken}, []
    for name in names:
        new = f"__{name}"
        while new.lower() in low:
            new += "_"
        low.add(new.lower())
        out.append(new)
    return out


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, computed exactly once a row.

    A generator of one element: the optimizer neither copies its expression into later ones nor pushes filters on it
    below, either of which would multiply long expressions until they no longer compile.
    """
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()), F.explode(F.array(value)).alias(name))
