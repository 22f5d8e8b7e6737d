"""Cutting lineage where a result is read several times."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as named in ``spark.checkpoint.dir``.

    A local master without that setting gets a folder of its own, deleted when
    Python ends.  A cluster without it is an error: files of one machine would be
    lost to the others.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the driver and the executors")
        _OWN.append(tempfile.TemporaryDirectory(prefix="plumbline-checkpoint-", ignore_cleanup_errors=True))
        folder = _OWN[-1].name
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder, where they survive lost executors.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` the files go when the rows are no longer used.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
