"""Cutting lineage with tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import DataFrame

from gridpulse.session import scratch_folder


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet in the shared folder and read again.

    Later steps read files, so a lost executor costs a re-read and no recomputation, and a
    task that runs twice sees the same rows.
    """
    path = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return memory this process has freed to the system, where its C library can.

    Training leaves the driver's heap in many small free pieces, which would stay with the
    process for as long as it runs.
    """
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass
