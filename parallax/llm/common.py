"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Held-out rows are those whose crc32(doc_id as text) leaves this remainder modulo HOLD_OUT_MOD.
HOLD_OUT_MOD = 3
HOLD_OUT_REST = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of a batch that a Python worker gets at once; texts may be long, and workers share an executor's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(df: DataFrame) -> None:
    """Lower the session's Arrow batch sizes to what the operators here are made for, if they are larger."""
    conf = df.sparkSession.conf
    rows = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HOLD_OUT_MOD == HOLD_OUT_REST


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for added columns that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_hash(text: Column) -> Column:
    """128 bits that tell texts apart; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir. Only where none is set and all runs in one process is a folder of our own used."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that holds this application's checkpoints."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder in Spark's file system; its absence is no error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, *, clean: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder; without ``clean`` old shuffle files go when the driver collects garbage."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    if not clean:
        return out
    # Shuffle files that only the cut lineage used can go now, not when the driver happens to collect its garbage.
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def sub_batches(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text column holds about max_bytes each (one row at least)."""
    lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        n = 0 if n is None or n != n else int(n)
        if held and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
