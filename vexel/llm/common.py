"""Shared helpers: column selection, shared folders, Arrow buffering and ragged gathers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch. The same for all operators, as plans are lazy and the setting is the session's.
ARROW_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Python workers by the bytes of an Arrow batch, for the session; a larger row is one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")


#: Working folders and tables that nobody has dropped yet, of each scope.
_working: ContextVar[list[tuple[str, str]]] = ContextVar("working", default=[])  # noqa: B039


@contextmanager
def scope():
    """A list of its own for what is stored within, so that release() there leaves alone what others store meanwhile, be it
    in other threads or around it. What is left at the end goes to the scope around."""
    outer, own = _working.get(), []
    token = _working.set(own)
    try:
        yield
    finally:
        _working.reset(token)
        outer += own


def shared_dir(spark: SparkSession) -> str:
    """A new folder path under spark.checkpoint.dir, which all executors see. Only a local session may go without that
    setting; on a cluster, a folder of one machine would lose rows."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="vexel-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/vexel-{uuid.uuid4().hex}"
    _working.get().append(("folder", path))
    return path


def put_table(df: DataFrame, name: str, buckets: int, by: str) -> None:
    """Stores df as a table that is bucketed and sorted by a column; its files are in the shared folder."""
    writer = df.write.option("compression", "zstd").option("path", shared_dir(df.sparkSession)).bucketBy(buckets, by).sortBy(by)
    writer.saveAsTable(name)
    _working.get().append(("table", name))


def let_go(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what nobody refers to any more: it does so when the driver collects its
    garbage, which a driver with little to do does seldom."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def working() -> int:
    """A mark for release(): what is stored from now on comes after it."""
    return len(_working.get())


def release(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Drops the working tables and folders that this scope stored since a mark, but for the folder `keep`. Operators give lazy results
    that read them, so this is for when the results are written or no longer wanted."""
    held = _working.get()
    for kind, name in held[since:]:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        elif name != keep:
            dropped(spark, name)
    held[since:] = [("folder", keep)] if keep else []


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder that stored() wrote, through Hadoop's file system interface."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", binary: bool = True) -> DataFrame:
    """Only the id and the text (null: empty), under the names `id` and `text`; other columns can't clash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), (text.cast("binary") if binary else text).alias("text"))


def buffered(batches, limit: int, size=len, column: str = "text"):
    """Joins Arrow batches until their texts hold about `limit` bytes: lists of columns, as {name: list}."""
    held: dict[str, list] = {}
    n = 0
    for batch in batches:
        cols = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        for name, values in cols.items():
            held.setdefault(name, []).extend(values)
        n += sum(map(size, cols[column]))
        if n >= limit:
            yield held
            held, n = {}, 0
    if held and len(held[column]):
        yield held


def ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices flat[starts[i] : starts[i] + lens[i]], one after another."""
    total = int(lens.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lens)
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(total)]
