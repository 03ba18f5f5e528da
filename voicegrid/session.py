"""Session helpers: shared scratch space, lineage cuts, bounded broadcasts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may run without the setting; it then gets a folder of
    its own, which the session's context keeps.  A cluster must name a folder
    that every executor can reach.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("Set spark.checkpoint.dir to a folder shared by the cluster.")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="voicegrid-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later jobs read files, so a lost executor costs nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def write_scratch_table(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet below the shared folder and return its path."""
    path = f"{scratch_dir(df.sparkSession)}/voicegrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def scratch_table(df: DataFrame, name: str, schema: T.StructType | None = None) -> DataFrame:
    """``df`` written once and read back, optionally under another schema."""
    path = write_scratch_table(df, name)
    reader = df.sparkSession.read
    return (reader.schema(schema) if schema is not None else reader).parquet(path)


def compact_table(df: DataFrame, name: str, *, beside: Sequence[str] = (), place: Sequence[str] = ()) -> DataFrame:
    """``df`` written once in little space and read back; shuffle files that it took are given up.

    The string columns ``beside`` lie in one array, where nearly equal texts of
    a row compress together.  ``place`` names two columns to add: the file and
    the number of each row, which do not depend on how the table is read.
    """
    packed = [column for column in dict.fromkeys(beside) if column in df.columns]
    apart = [F.col(f"`{column}`") for column in df.columns if column not in packed]
    path = f"{scratch_dir(df.sparkSession)}/voicegrid/{name}-{uuid.uuid4().hex}"
    rows = df.select(*apart, F.array(*packed).alias("_beside")) if len(packed) > 1 else df
    rows.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    stored = df.sparkSession.read.schema(rows.schema).parquet(path)
    if len(packed) > 1:
        found = {column: F.col("_beside")[k].alias(column) for k, column in enumerate(packed)}
    else:
        found = {}
    columns = [found.get(column, F.col(f"`{column}`")) for column in df.columns]
    located = zip((F.col("_metadata.file_name"), F.col("_metadata.row_index")), place)
    return stored.select(*columns, *(value.alias(column) for value, column in located))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver's garbage is collected, which a large heap puts
    off while the disks fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters must not duplicate.

    The optimizer copies a projected expression into every filter on it and
    pushes the copy to the scan.  A one-element explode stops that; it neither
    shuffles nor leaves generated code.
    """
    kept = [column for column in df.columns if column != name]
    return df.select(*kept, F.explode_outer(F.array(value)).alias(name))


def rows_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table (vocabulary, labels, report rows)."""
    return spark.createDataFrame(rows, schema)


def join_small(
    left: DataFrame, small: DataFrame, on, how: str, *, rows: int, limit: int = 100_000
) -> DataFrame:
    """Join with a side whose row count is known: broadcast up to ``limit`` rows, else shuffle."""
    return left.join(F.broadcast(small) if rows <= limit else small, on, how)
