"""TIFF stacks: multi-page grey images of 8, 16 and 32 bits (integer or float), in strips without compression."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.taps import natural_key

# Fixed values of the TIFF 6.0 format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
SIZES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}


def decode(data: bytes) -> np.ndarray:
    """(pages, height, width) float32 or float64; all pages must be of one size."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, pages = struct.unpack(order + "I", data[4:8])[0], []
    while at:
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in SIZES:
                code, size = SIZES[kind]
                where = at + 10 + 12 * i
                if size * count > 4:
                    where = struct.unpack_from(order + "I", data, where)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
        if tags.get(COMPRESSION, (1,))[0] != 1 or tags.get(SAMPLES, (1,))[0] != 1:
            raise ValueError("only uncompressed grey images are read")
        bits, form = tags.get(BITS, (8,))[0], tags.get(FORMAT, (1,))[0]
        if bits not in (8, 16, 32, 64) or (form == 3 and bits < 32):
            raise ValueError(f"{bits} bits of format {form} are not read")
        dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form]}{bits // 8}")
        raw = b"".join(data[a : a + b] for a, b in zip(tags[STRIPS], tags[STRIP_BYTES], strict=True))
        page = np.frombuffer(raw, dtype).reshape(tags[HEIGHT][0], tags[WIDTH][0])
        pages.append(page.astype(np.float64 if bits == 64 else np.float32))
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    if not pages or len({p.shape for p in pages}) != 1:
        raise ValueError("the pages must have one size")
    return np.stack(pages)


def encode(stack: np.ndarray) -> bytes:
    """A multi-page file of 32-bit float images, one strip each."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    for i, page in enumerate(stack):
        h, w = page.shape
        entries = [(WIDTH, 4, w), (HEIGHT, 4, h), (BITS, 3, 32), (COMPRESSION, 3, 1), (PHOTOMETRIC, 3, 1), (STRIPS, 4, 0), (SAMPLES, 3, 1), (ROWS_PER_STRIP, 4, h), (STRIP_BYTES, 4, 4 * h * w), (FORMAT, 3, 3)]
        at = len(out)
        pixels = at + 2 + 12 * len(entries) + 4
        end = pixels + 4 * h * w
        out += struct.pack("<H", len(entries))
        for tag, kind, value in entries:
            value = pixels if tag == STRIPS else value
            out += struct.pack("<HHI", tag, kind, 1) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
        out += struct.pack("<I", end if i + 1 < len(stack) else 0) + page.astype("<f4").tobytes()
    return bytes(out)


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """(slice_id, height, width, values) of a file or a folder of .tif/.tiff files; slices go by natural file order, then page.

    Files are read and decoded by the executors through Spark's own reader, so any store will do."""
    files = spark.read.format("binaryFile").load(path).filter(F.lower("path").rlike(r"\.tiff?$"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for page, a in enumerate(decode(batch.column(1)[i].as_py())):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([page], pa.int32()), pa.array([a.shape[0]], pa.int32()), pa.array([a.shape[1]], pa.int32()), pa.array([a.ravel().astype(float)], pa.list_(pa.float64()))], names=["path", "page", "height", "width", "values"])

    pages = files.select("path", "content").mapInArrow(run, "path string, page int, height int, width int, values array<double>")
    # places are counted over names and numbers of pages, not over pixels
    names = pages.select("path", "page")
    from pyspark.sql import Window

    key = natural_key(F.element_at(F.split("path", "/"), -1))
    place = names.select("path", "page", (F.row_number().over(Window.orderBy(key, "path", "page")) - 1).alias("slice_id"))
    return pages.join(place, ["path", "page"]).select("slice_id", "height", "width", "values")


def write_tiff(slices: DataFrame, path: str) -> None:
    """One file for each slice in a folder of a shared file system, named so that natural order is slice order."""
    spark = slices.sparkSession
    encoded = slices.select("slice_id", "height", "width", "values")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                data = encode(np.asarray(r["values"], np.float32).reshape(1, r["height"], r["width"]))
                yield pa.RecordBatch.from_arrays([pa.array([r["slice_id"]], pa.int32()), pa.array([data], pa.binary())], names=["slice_id", "content"])

    files = encoded.mapInArrow(run, "slice_id int, content binary")
    spark.dataSource.register(TiffSink)
    files.write.format("tiff_files").mode("append").save(path)


from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage  # noqa: E402


class TiffSink(DataSource):
    """Sink of encoded files; each goes to its name in one step, so a task that runs twice leaves one file."""

    @classmethod
    def name(cls):
        return "tiff_files"

    def schema(self):
        return "slice_id int, content binary"

    def writer(self, schema, overwrite):
        return TiffWriter(self.options["path"])


class TiffWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://").removeprefix("file:")

    def write(self, iterator):
        import os
        import uuid

        os.makedirs(self.path, exist_ok=True)
        for row in iterator:
            final = os.path.join(self.path, f"slice_{row.slice_id:06d}.tif")
            part = f"{final}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(row.content)
            os.replace(part, final)
        return WriterCommitMessage()


def save(slices: DataFrame, path: str, kind: str = "parquet", original: DataFrame | None = None, what: str = "processed") -> None:
    """Save the original, the processed stack or their difference, as parquet, tiff or hdf5."""
    if what == "original":
        out = original
    elif what == "difference":
        other = original.select("slice_id", F.col("values").alias("_o"))
        out = slices.join(other, "slice_id").select("slice_id", "height", "width", F.zip_with("_o", "values", lambda a, b: a - b).alias("values"))
    else:
        out = slices
    if kind == "tiff":
        write_tiff(out, path)
    elif kind == "parquet":
        out.write.mode("overwrite").parquet(path)
    elif kind == "hdf5":
        from .hdf5 import write_hdf5

        write_hdf5(out, path)
    else:
        raise ValueError(f"unknown format {kind}")


def load(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Slices by file extension: h5, hdf5, nxs; tif, tiff or a folder of them; npy; parquet."""
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if end in ("h5", "hdf5", "nxs"):
        from .hdf5 import read_hdf5

        return read_hdf5(spark, path, dataset)
    if end == "npy":
        from .synthetic import from_npy

        return from_npy(spark, path)
    if end == "parquet":
        return spark.read.parquet(path)
    return read_tiff(spark, path)
