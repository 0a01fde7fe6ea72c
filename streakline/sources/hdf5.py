"""HDF5 datasets of rank 3; needs the optional h5py on the driver and the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("HDF5 files need the optional package h5py") from e
    return h5py


def read_hdf5(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Slices of a dataset, read by range of the first axis in the tasks; integers widen to double."""
    h5py = _h5py()
    with h5py.File(path, "r") as f:
        shape = f[dataset].shape
    if len(shape) != 3:
        raise ValueError("a dataset of three dimensions is needed")

    def run(batches):
        import pyarrow as pa

        with h5py.File(path, "r") as f:
            data = f[dataset]
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    a = np.asarray(data[i], float)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([a.shape[0]], pa.int32()), pa.array([a.shape[1]], pa.int32()), pa.array([a.ravel()], pa.list_(pa.float64()))], names=["slice_id", "height", "width", "values"])

    return spark.range(shape[0]).mapInArrow(run, "slice_id int, height int, width int, values array<double>")


def catalog_hdf5(spark: SparkSession, path: str) -> DataFrame:
    """(path, parent, kind, shape, dtype) of every group and dataset."""
    h5py = _h5py()
    rows = []
    with h5py.File(path, "r") as f:

        def visit(name, node):
            data = isinstance(node, h5py.Dataset)
            rows.append(("/" + name, "/" + name.rpartition("/")[0], "dataset" if data else "group", list(node.shape) if data else None, str(node.dtype) if data else None))

        f.visititems(visit)
    return spark.createDataFrame(rows, "path string, parent string, kind string, shape array<bigint>, dtype string")


def write_hdf5(slices: DataFrame, path: str, dataset: str = "/data/stack") -> None:
    """One file holds one stack, so the driver writes it slice by slice, never the whole."""
    h5py = _h5py()
    first = slices.select("height", "width").first()
    n = slices.count()
    with h5py.File(path, "w") as f:
        out = f.create_dataset(dataset, (n, first.height, first.width), "f4")
        for i, r in enumerate(slices.orderBy("slice_id").toLocalIterator()):
            out[i] = np.asarray(r["values"], np.float32).reshape(r["height"], r["width"])
