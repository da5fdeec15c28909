"""Helpers shared by the text operators: tables, folds, shared folders, tokenizer files."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from linepulse.session import shared_dir

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def fold(doc_id: str = "doc_id") -> Column:
    """0..4 from crc32 of the id as text; fold 0 is held out of all learning."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5)).cast("int")


def run_path(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared folder (spark.checkpoint.dir)."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


DONE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The step's shuffle files go with its end: nothing reads them again, and the driver may not collect its garbage for long."""
    spark = df.sparkSession
    path, before = run_path(spark, name), spark.conf.get(DONE_SHUFFLES, None)
    spark.conf.set(DONE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(DONE_SHUFFLES)
        else:
            spark.conf.set(DONE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(*steps: DataFrame) -> None:
    """Remove the folders of ``written`` steps that nothing reads any more, neither these frames nor any made from them."""
    for df in steps:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


FEW = 2_000_000   # rows of two numbers that are sent to all tasks, counted first


def few(df: DataFrame, n: int) -> DataFrame:
    """``df`` for a join: sent to all tasks where it was counted to be small."""
    return F.broadcast(df) if n <= FEW else df


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; a path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def ship(spark: SparkSession) -> None:
    """Let the workers of this session import the package, also where it is not installed on them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    sc = spark.sparkContext
    if getattr(sc, "_linepulse_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    to = os.path.join(tempfile.mkdtemp(prefix="linepulse-"), "linepulse.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(to)
    sc._linepulse_shipped = True


_KEPT: list = []     # what workers remember between tasks


def per_worker(function):
    """One value per argument and worker process, kept between tasks until another operator needs the memory."""
    kept = lru_cache(maxsize=4)(function)
    _KEPT.append((function.__module__, kept))
    return kept


def make_room(*modules: str) -> None:
    """Forget what this worker remembers of modules other than these: workers serve many operators in turn."""
    others = [kept for module, kept in _KEPT if module.rpartition(".")[2] not in modules]
    full = any(kept.cache_info().currsize for kept in others)
    for kept in others:
        kept.cache_clear()
    if full or not _SERVED or _SERVED[-1] != modules:
        give_back()
    _SERVED[:] = [modules]


_SERVED: list = []   # the modules that this worker served last


def give_back() -> None:
    """Return freed memory to the system; allocators keep it otherwise, and a worker's executor has other uses for it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # of the GNU C library only
    if trim is not None:
        trim(0)


BATCH_ROWS = 2000    # texts are long: rows that go to a worker at a time


def in_arrow(df: DataFrame, run, schema: str, uses: tuple[str, ...] = ()) -> DataFrame:
    """``mapInArrow`` with functions of this package: numbers beside nulls stay what they are."""
    def task(batches):
        make_room(*uses)
        yield from run(batches)

    ship(df.sparkSession)
    return df.mapInArrow(task, schema)


def beside(left: DataFrame, right: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """Cogroup two frames on ``keys`` and apply ``run(key, left table, right table)``, Arrow tables in and out."""
    ship(left.sparkSession)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def in_pandas(df: DataFrame, run, schema: str, uses: tuple[str, ...] = ()) -> DataFrame:
    """``run`` over pandas frames of the rows, with functions of this package.  uses: modules whose per-worker values it needs.

    Integers beside nulls come as pandas' Int64, so that large ids are not rounded.
    """
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def frames(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            for name, column in zip(batch.schema.names, batch.columns):
                if pa.types.is_integer(column.type) and column.null_count:
                    pdf[name] = column.cast(pa.int64()).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            yield pdf

    def task(batches):
        for pdf in run(frames(batches)):
            yield pa.RecordBatch.from_pandas(pdf, schema=shape, preserve_index=False)

    return in_arrow(df, task, schema, uses)
