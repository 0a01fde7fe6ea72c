"""Image views over tables, and converters between pixel, row and slice form.

Pixel form is (slice_id, row, col, value); row form has one array per image row;
slice form one row-major array per image, the unit of the numeric kernels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIXEL = ["slice_id", "row", "col", "value"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image in row form: a row per vector, a column per component."""
    return _read(spark, sf_dir, "embeddings").select(F.lit(0).alias("slice_id"), F.col("vec_id").cast("int").alias("row"), F.col("embedding").cast("array<double>").alias("values"))


def embedding_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_rows(embedding_rows(spark, sf_dir))


def _dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks from 0 on of the distinct values of an image's axis, which is no longer than a row of the image."""
    return df.select(column).distinct().select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias(name))


def dense_rows(cells: DataFrame, slices: DataFrame) -> DataFrame:
    """Rows (slice_id, row, values) of the full grid of the cells' rows and columns (numbered from 0) in every one of ``slices``; 0 where there is no cell.

    Each row is packed once from its few cells, so the grid itself is never joined."""
    width = cells.agg((F.max("col") + 1).alias("_w"))
    places = slices.select("slice_id").distinct().join(cells.select("row").distinct())
    packed = cells.groupBy("slice_id", "row").agg(F.collect_list("col").alias("_at"), F.collect_list("value").alias("_v"))
    sparse = places.join(packed, ["slice_id", "row"], "left").join(F.broadcast(width))  # one row

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column(4)[0].as_py() if batch.num_rows else 0
            at, held = batch.column(2), batch.column(3)
            sizes = pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False)
            dense = np.zeros((batch.num_rows, w))
            dense[np.repeat(np.arange(batch.num_rows), sizes), at.flatten().to_numpy(zero_copy_only=False)] = held.flatten().to_numpy(zero_copy_only=False)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * w)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(dense.ravel()))], names=["slice_id", "row", "values"])

    work = sparse.select(F.col("slice_id").cast("int").alias("slice_id"), F.col("row").cast("int").alias("row"), F.col("_at").cast("array<int>").alias("_at"), F.col("_v").cast("array<double>").alias("_v"), F.col("_w").cast("int").alias("_w"))
    return work.repartition(tasks(work)).mapInArrow(fill, "slice_id int, row int, values array<double>")  # few cells make many pixels


def _event_rows(spark: SparkSession, sf_dir: str, by_type: bool) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    hour = F.floor((F.unix_timestamp("ts") - F.lit(1704067200)) / 3600).cast("int").alias("row")
    facts = events.select(hour, "user_id", "event_type", "value")
    keys = ["row", "user_id"] + ["event_type"] * by_type
    cells = facts.groupBy(*keys).agg(F.sum("value").alias("value")).join(_dense_ids(events, "user_id", "col"), "user_id")
    if by_type:
        types = _dense_ids(events, "event_type", "slice_id")
        return dense_rows(cells.join(types, "event_type").select(*PIXEL), types)
    return dense_rows(cells.select(F.lit(0).alias("slice_id"), "row", "col", "value"), spark.range(1).select(F.col("id").alias("slice_id")))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours by users; sums of the events' values."""
    return _event_rows(spark, sf_dir, False)


def event_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_rows(event_rows(spark, sf_dir))


def event_stack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``event_rows``, a slice for each event type."""
    return _event_rows(spark, sf_dir, True)


def event_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_rows(event_stack_rows(spark, sf_dir))


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months since 1995-01 by suppliers; sums of extended prices."""
    items = _read(spark, sf_dir, "lineitem").select("l_shipdate", "l_suppkey", "l_extendedprice")
    month = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).alias("row")
    cells = items.groupBy(month, "l_suppkey").agg(F.sum("l_extendedprice").alias("value"))
    cells = cells.join(_dense_ids(items, "l_suppkey", "col"), "l_suppkey")
    return dense_rows(cells.select(F.lit(0).alias("slice_id"), "row", "col", "value"), spark.range(1).select(F.col("id").alias("slice_id")))


def lineitem_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_rows(lineitem_rows(spark, sf_dir))


def to_rows(pixels: DataFrame) -> DataFrame:
    """(slice_id, row, values): values by column."""
    packed = pixels.groupBy("slice_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("p"))
    return packed.select("slice_id", "row", F.col("p.value").alias("values"))


def from_rows(rows: DataFrame) -> DataFrame:
    return rows.select("slice_id", "row", F.posexplode("values").alias("col", "value"))


def to_columns(pixels: DataFrame) -> DataFrame:
    """(slice_id, col, values): values by row."""
    packed = pixels.groupBy("slice_id", "col").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("p"))
    return packed.select("slice_id", "col", F.col("p.value").alias("values"))


def from_columns(columns: DataFrame) -> DataFrame:
    return columns.select("slice_id", "col", F.posexplode("values").alias("row", "value")).select(*PIXEL)


def rows_to_slices(rows: DataFrame) -> DataFrame:
    """(slice_id, height, width, values): dense row-major images; rows are taken in order."""
    images = rows.groupBy("slice_id").agg(F.array_sort(F.collect_list(F.struct("row", F.col("values").alias("v")))).alias("r"))
    return images.select("slice_id", F.size("r").alias("height"), F.size(F.col("r.v")[0]).alias("width"), F.flatten("r.v").alias("values"))


def numbered(rows: DataFrame, some: int = 4096) -> DataFrame:
    """``rows`` with their place in the image (from 0 on, in order of row) and the image's height.

    Counted by ranges of row numbers, so that only one count a range is ordered in one task."""
    ranged = rows.withColumn("_range", F.floor(F.col("row") / some))
    counts = ranged.groupBy("slice_id", "_range").agg(F.count("*").alias("_n"))
    image = Window.partitionBy("slice_id")
    before = counts.select("slice_id", "_range", (F.sum("_n").over(image.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(image).alias("height"))
    within = F.row_number().over(Window.partitionBy("slice_id", "_range").orderBy("row", "values")) - 1
    return ranged.withColumn("_within", within).join(before, ["slice_id", "_range"]).select("slice_id", (F.col("_before") + F.col("_within")).cast("int").alias("place"), F.col("height").cast("int").alias("height"), "values")


def to_slices(pixels: DataFrame) -> DataFrame:
    """Slices of pixels; rows and columns are taken in order."""
    return rows_to_slices(to_rows(pixels))


def map_rows(rows: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A function of a matrix, row by row, on the arrays of ``rows`` (its last column, values); arrays of one length go together.  A missing value counts as NaN."""
    keys = [c for c in rows.columns if c != "values"]
    src = rows.select(*keys, F.col("values").cast("array<double>").alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == n))
                out = fn(lists.take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)) if n else np.empty((len(at), 0))
                offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * out.shape[1])
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(len(keys))], pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=batch.schema.names)

    return src.mapInArrow(run, src.schema)


def from_slices(slices: DataFrame, dealt: bool = False) -> DataFrame:
    """Pixels of slices; with ``dealt`` the rows of few large slices are first dealt out over all tasks."""
    if dealt:
        return from_rows(slices_to_rows(slices).repartition(tasks(slices)))
    long = slices.select("slice_id", "width", F.posexplode("values").alias("at", "value"))
    return long.select("slice_id", F.floor(F.col("at") / F.col("width")).cast("int").alias("row"), (F.col("at") % F.col("width")).cast("int").alias("col"), "value")


def tasks(df: DataFrame) -> int:
    """How many tasks rows of large arrays are dealt to."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices_to_rows(slices: DataFrame) -> DataFrame:
    """(slice_id, row, values) of slices, without a shuffle."""
    kind = dict(slices.dtypes)["values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, w, values = batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].values
                some = max(1, (1 << 20) // max(1, w))
                for r in range(0, h, some):
                    n = min(some, h - r)
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), values.slice(r * w, n * w))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[i].as_py(), np.int32)), pa.array(np.arange(r, r + n, dtype=np.int32)), rows], names=["slice_id", "row", "values"])

    src = slices.select(*[F.col(c).cast("int").alias(c) for c in ("slice_id", "height", "width")], "values")
    return src.mapInArrow(run, f"slice_id int, row int, values {kind}")


def slice_axis(voxels: DataFrame, axis: str, row_axis: str, col_axis: str, at: int | None = None) -> DataFrame:
    """Slices of a (d0, d1, d2, value) cube along ``axis``; the filter on one slice reaches the scan."""
    if len({axis, row_axis, col_axis}) != 3:
        raise ValueError("three different axes are needed")
    df = voxels if at is None else voxels.filter(F.col(axis) == at)
    return df.select(F.col(axis).alias("slice_id"), F.col(row_axis).alias("row"), F.col(col_axis).alias("col"), "value")
