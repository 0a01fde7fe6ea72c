"""Shared helpers: reading tables, shared scratch space, Arrow row mapping."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space of the contracts: [\x20\x09-\x0D].
WS_BYTES = b" \t\n\x0b\x0c\r"
#: Text bytes that a Python step takes in one slice, so that long texts do not add up.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a session on this machine alone (``local[...]``, as in tests) gets a folder of the machine;
    a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="streakline-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: str | Column) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (id, text as bytes); every other column, whatever its name, is pruned."""
    return docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_text"))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the texts of ``column`` add up to ``limit`` bytes."""
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


#: What an operator keeps in a Python worker from task to task, under the operator's name.
_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """The state that ``owner`` keeps in this worker.

    Workers are reused by whatever runs next, so the state of all others is let go: a worker holds one operator's state at a time."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = {}
        tidy()
    return _KEPT[owner]


def tidy() -> None:
    """Give memory that is no longer in use back to the machine, at the end of a task.

    State that is kept may have a function under "rest", which first lets go of what was only gathered on the way."""
    for state in _KEPT.values():
        if "rest" in state:
            state["rest"]()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: T.StructType | str, text: str = "_text") -> DataFrame:
    """``mapInArrow`` of a per-slice function; slices are bounded in bytes of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
        batch = part = out = None
        tidy()

    return df.mapInArrow(run, schema)


def with_columns_arrow(df: DataFrame, text_col: str, fn: Callable[[list[bytes | None]], dict[str, pa.Array]], fields: list[tuple[str, str]], limit: int = SLICE_BYTES) -> DataFrame:
    """All columns of ``df`` plus those that ``fn`` makes of the texts.

    A column of the input that has the name of an output column is replaced,
    except ``text_col`` itself when ``fields`` names it: then it holds the new text.
    """
    names = {n for n, _ in fields}
    keep = [c for c in df.columns if c not in names]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").cast("binary").alias("_src_text"))
    schema = T.StructType([f for f in src.schema.fields if f.name != "_src_text"] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_src_text", limit):
                at = part.schema.get_field_index("_src_text")
                made = fn(part.column(at).to_pylist())
                arrays = [part.column(i) for i in range(part.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays(arrays + [made[n] for n, _ in fields], names=[part.schema.names[i] for i in range(part.num_columns) if i != at] + [n for n, _ in fields])
        batch = part = made = arrays = None
        tidy()

    return src.mapInArrow(run, schema)
