"""Helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of any script, for the regular expressions of Spark and of the SQL checks alike.
SPACE = r"[\s\p{Z}]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column called exactly ``name``, dots and dashes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def tidy(text: Column) -> Column:
    """Text without white space at its ends; null where nothing is left."""
    return F.nullif(F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", ""), F.lit(""))


def latest(df: DataFrame, keys: Sequence[str], values: Sequence[str], by: str = "loaded_at") -> DataFrame:
    """Of the rows with equal ``keys`` the one with the largest ``by``, as columns ``keys`` + ``values``.

    Null keys form a group like any other.  A null ``by`` is older than any
    other; rows that tie in ``by`` are told apart by their values, so the
    result is the same whatever the order of the rows.  Aggregated on the map
    side before the only shuffle.
    """
    row = F.struct(quoted(by).alias("__by"), *(quoted(v).alias(f"__v{i}") for i, v in enumerate(values)))
    best = df.groupBy(*(quoted(k) for k in keys)).agg(F.max(row).alias("__best"))
    return best.select(*(quoted(k) for k in keys), *(F.col(f"__best.__v{i}").alias(v) for i, v in enumerate(values)))


def unpaired_null(value: Column) -> Column:
    """A floating-point value with NaN as null."""
    return F.when(~F.isnan(value), value)


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints that every executor sees.

    Taken from ``spark.checkpoint.dir``; where the session does not set it (as
    in local tests) a folder below the warehouse directory is used.  On a
    cluster that must not be a folder of one machine, which is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "__checkpoints")
        if not context.master.startswith("local") and (folder.startswith("file:") or "://" not in folder):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = folder.removeprefix("file:")
    if context.getCheckpointDir() is None:
        # files of a checkpoint go when nothing refers to it any more
        context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read again from the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes per core below which an input is moved to be worked on by all cores: the size of Spark's smallest split.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it has fewer splits than cores and less than one smallest split per core; unchanged otherwise.

    Spark reads so small an input in a task or two, whatever is done with each
    row.  What is moved is bounded by ``SPREAD_BYTES`` a core; an input of any
    larger size is never shuffled, however few files it has.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of a session, once, as they may run in another folder or on another machine."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):  # not from an archive, which is shipped already
        folder = tempfile.mkdtemp()  # of the driver alone, until Spark has its copy
        context.addPyFile(shutil.make_archive(os.path.join(folder, "seqloom"), "zip", os.path.dirname(package), "seqloom"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _shipped.add(context.applicationId)
