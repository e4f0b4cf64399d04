"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlens.session import shared_folder

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same characters, for trimming.
SPACES = " \t\n\r\x0b\x0c"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated a single time, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3.

    A missing id is not held out (and carries no label to learn from).
    """
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def n_words(text: Column) -> Column:
    """Number of words; 0 for a missing text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the folder that the cluster names in ``spark.checkpoint.dir``.

    Cuts the lineage: what follows survives lost executors without redoing what came before,
    and several uses share one computation.
    """
    spark = frame.sparkSession
    path = shared_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
