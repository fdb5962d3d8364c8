"""Helpers that the training-data operators share: tables, the shared folder, white space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: space and U+0009 to U+000D, as a Java character class.
SPACES = r"[\x20\x09-\x0D]+"
#: The same characters, for ``btrim``.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Same characters as bytes, for vectorised scans.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the session's ``spark.checkpoint.dir`` says.

    Where that is unset, a session on this machine alone, as in tests, gets a temporary folder; a
    cluster raises, for its executors would each write to a folder of their own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="failscope-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the written table.

    It cuts lineage: a lost executor costs the tasks that it ran, not the stages before the table.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at, compression="zstd")
    return spark.read.schema(df.schema).parquet(at)


def whole_text(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken, *names: str) -> list[str]:
    """Column names like ``names`` that none of the columns ``taken`` has, whatever their case."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


#: Tables are broadcast by hint only if all their rows fit into so many bytes.
BROADCAST_BYTES = 32 << 20


def by_size(written: DataFrame, row_bytes: int) -> DataFrame:
    """A written table with the hint to broadcast it if its rows, of ``row_bytes`` bytes each at most,
    are known to fit into ``BROADCAST_BYTES``; else as it is, for a join that shuffles and can split
    hot keys. The count comes from the files' footers."""
    return F.broadcast(written) if written.count() * row_bytes <= BROADCAST_BYTES else written
