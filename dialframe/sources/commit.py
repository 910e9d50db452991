"""Write-if-absent that leaves one whole set: staging folder, rename, marker last.

A target is *complete* when it is a file, or a folder that holds the marker
``_SUCCESS``.  A set is written to a hidden staging folder beside the target,
moved to its name in one rename that fails where the name is taken, and marked
afterwards.  So:

* a job that fails or a driver that dies leaves nothing under the target's name,
  or a folder without marker, which the next writer sets aside;
* of two writers that finish together one set is moved in whole; the other writer
  finds the target taken, and drops its own (or, if the first died before its
  marker, sets that one aside and moves in its own);
* the marker never creates the folder it stands in, so it cannot mark a folder that
  another writer has just set aside.

On a store whose rename is a copy, the marker still comes last; readers that look
for it never see half a set.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialframe.session import delete_at_end, file_system

MARKER = "_SUCCESS"


def _child(hp, name: str):
    return hp.suffix("/" + name)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a file or a folder with the marker."""
    fs, hp = file_system(spark, path)
    return fs.exists(hp) and (fs.getFileStatus(hp).isFile() or fs.exists(_child(hp, MARKER)))


def staging_path(path: str) -> str:
    """A new hidden sibling of ``path`` (Spark's readers skip names that begin with a dot)."""
    head, _, name = path.rstrip("/").rpartition("/")
    return f"{head + '/' if head else ''}.{name}.staging-{uuid.uuid4().hex}"


def _mark(fs, hp) -> bool:
    """Create the marker in an existing folder; False if the folder has gone."""
    try:
        fs.createNonRecursive(_child(hp, MARKER), True, 4096, fs.getDefaultReplication(hp), fs.getDefaultBlockSize(hp),
                              None).close()
        return True
    except Py4JJavaError:
        if fs.exists(hp):
            raise
        return False


def _rename(spark: SparkSession, fs, src, dst) -> bool:
    """Move ``src`` to the free name ``dst``; False if the name is taken."""
    jvm = spark.sparkContext._jvm
    qualified = fs.makeQualified(src)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(),
                                                                  spark.sparkContext._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 0)
    try:
        context.rename(qualified, fs.makeQualified(dst), options)
        return True
    except Py4JJavaError:
        if fs.exists(dst):
            return False
        raise


def publish(spark: SparkSession, staging: str, path: str) -> bool:
    """Move the whole set in ``staging`` to ``path`` and mark it; False if another complete set stood there.

    The staging folder is gone afterwards in either case.
    """
    fs, src = file_system(spark, staging)
    _, dst = file_system(spark, path)
    try:
        fs.delete(_child(src, MARKER), False)  # the job's own: the marker is to come last
        fs.mkdirs(dst.getParent())
        while not is_complete(spark, path):
            if not fs.exists(dst):
                if _rename(spark, fs, src, dst) and _mark(fs, dst):
                    return True
                if not fs.exists(src):  # moved in, then set aside by another writer, which moves in its own
                    return False
            else:
                aside = file_system(spark, staging_path(path))[1]
                try:
                    moved = _rename(spark, fs, dst, aside)
                except Py4JJavaError:
                    if fs.exists(dst):
                        raise
                    moved = False  # another writer was faster
                if moved:
                    fs.delete(aside, True)
        return False
    finally:
        fs.delete(src, True)


def write_if_absent(df: DataFrame, path: str, fmt: str = "json") -> bool:
    """Write ``df`` unless ``path`` is complete (resume); True if this call's set is the one that stands there.

    ``df`` is not computed where the target is complete.
    """
    spark = df.sparkSession
    if is_complete(spark, path):
        return False
    staging = staging_path(path)
    delete_at_end(spark, staging)
    try:
        df.write.mode("error").format(fmt).save(staging)
    except BaseException:
        fs, hp = file_system(spark, staging)
        fs.delete(hp, True)
        raise
    return publish(spark, staging, path)


def write_parts_if_absent(df: DataFrame, part: str, paths: dict[int, str], fmt: str = "json") -> list[int]:
    """One pass over ``df`` that writes each value of the integer column ``part`` to its path; the values published.

    Rows of other values are not allowed (they would be written nowhere).  A value
    without rows gives an empty, complete set.  Paths that are complete already stay.
    """
    spark = df.sparkSession
    open_paths = {k: p for k, p in paths.items() if not is_complete(spark, p)}
    if not open_paths:
        return []
    staging = staging_path(next(iter(open_paths.values())))
    delete_at_end(spark, staging)
    fs, root = file_system(spark, staging)
    try:
        (df.where(F.col(part).isin(*open_paths)).write.mode("error").partitionBy(part).format(fmt).save(staging))
        done: list[int] = []
        for value, path in open_paths.items():
            one = _child(root, f"{part}={value}")
            fs.mkdirs(one)
            if publish(spark, one.toString(), path):
                done.append(value)
        return done
    finally:
        fs.delete(root, True)


def incomplete(spark: SparkSession, paths: Sequence[str]) -> list[int]:
    """1-based places of the paths that are not complete."""
    return [i for i, p in enumerate(paths, start=1) if not is_complete(spark, p)]
