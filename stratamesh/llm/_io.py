"""Tables in, cut lineage out."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamesh.staging import stage_dir, staged, unstage

__all__ = ["BLANK", "WORD", "beside", "give_back", "parts", "stage_dir", "table", "text_of", "unstage", "written"]
#: Code points that separate words, as the inside of a character class.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"
written = staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def beside(df: DataFrame, inputs: dict[str, Column], work: Callable[[DataFrame], DataFrame], outputs: dict[str, str]) -> DataFrame:
    """df with new columns that work() adds to a frame of `inputs` and the whole row.

    work() sees no column of df by name, so no name of df can clash with one it uses; outputs: name in the result -> name
    in what work() returns. A column of a result's name is replaced, all others stay as they are.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    done = work(df.select(row, *(c.alias(k) for k, c in inputs.items())))
    kept = [F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in outputs]
    return done.select(*kept, *(F.col(v).alias(k) for k, v in outputs.items()))


def give_back() -> None:
    """Returns a worker's unused memory to the machine. Workers outlive a stage, and what they keep counts in the next one too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
