"""Synthetic images: phantom, sinogram, detector gain, coloured noise, benchmark sinograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the modified Shepp-Logan phantom (Toft, 1996): intensity, semi-axes, centre, angle in degrees.
ELLIPSES = (
    (1.0, 0.69, 0.92, 0.0, 0.0, 0.0),
    (-0.8, 0.6624, 0.874, 0.0, -0.0184, 0.0),
    (-0.2, 0.11, 0.31, 0.22, 0.0, -18.0),
    (-0.2, 0.16, 0.41, -0.22, 0.0, 18.0),
    (0.1, 0.21, 0.25, 0.0, 0.35, 0.0),
    (0.1, 0.046, 0.046, 0.0, 0.1, 0.0),
    (0.1, 0.046, 0.046, 0.0, -0.1, 0.0),
    (0.1, 0.046, 0.023, -0.08, -0.605, 0.0),
    (0.1, 0.023, 0.023, 0.0, -0.606, 0.0),
    (0.1, 0.023, 0.046, 0.06, -0.605, 0.0),
)


def unit(a: np.ndarray, eps: float = 0.0) -> np.ndarray:
    span = a.max() - a.min() + eps
    return (a - a.min()) / span if span else a * 0.0


def shepp_logan(spark: SparkSession, size: int, contrast: float = 1.0) -> DataFrame:
    """Pixels of the phantom in [0, 1]: the grid of places, each with the sum of the ellipses that hold it (constants in the plan)."""
    y = 1 - F.col("row") * (2.0 / (size - 1))
    x = F.col("col") * (2.0 / (size - 1)) - 1
    value = F.lit(0.0)
    for v, a, b, x0, y0, deg in ELLIPSES:
        t = np.deg2rad(deg)
        u, w = (x - x0) * float(np.cos(t)) + (y - y0) * float(np.sin(t)), (y - y0) * float(np.cos(t)) - (x - x0) * float(np.sin(t))
        value = value + F.when(F.pow(u / a, 2) + F.pow(w / b, 2) <= 1, v * contrast).otherwise(0.0)
    pixels = spark.range(size * size).select(F.lit(0).alias("slice_id"), F.floor(F.col("id") / size).cast("int").alias("row"), (F.col("id") % size).cast("int").alias("col"))
    from ..operators.pointwise import minmax_stack

    return minmax_stack(pixels.withColumn("value", value)).select("slice_id", "row", "col", "value")


def to_diagonal(a: np.ndarray) -> np.ndarray:
    """Padded with zeros to a square as wide as its diagonal, its centre (n div 2) in the centre, so that no corner is lost."""
    diagonal = np.sqrt(2) * max(a.shape)
    grow = [int(np.ceil(diagonal - n)) for n in a.shape]
    before = [(n + g) // 2 - n // 2 for n, g in zip(a.shape, grow, strict=True)]
    return np.pad(a, [(b, g - b) for b, g in zip(before, grow, strict=True)])


def rotate(a: np.ndarray, degrees: float) -> np.ndarray:
    """Bilinear rotation about the pixel n div 2 of each axis; 0 outside."""
    h, w = a.shape
    t = np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w].astype(float)
    y, x = y - h // 2, x - w // 2
    sx, sy = np.cos(t) * x + np.sin(t) * y + w // 2, -np.sin(t) * x + np.cos(t) * y + h // 2
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    padded = np.pad(a, 1)
    get = lambda yy, xx: padded[np.clip(yy + 1, 0, h + 1), np.clip(xx + 1, 0, w + 1)]
    fx, fy = sx - x0, sy - y0
    return (1 - fy) * ((1 - fx) * get(y0, x0) + fx * get(y0, x0 + 1)) + fy * ((1 - fx) * get(y0 + 1, x0) + fx * get(y0 + 1, x0 + 1))


#: Added to scaled sinograms, so that none is 0.
FLOOR = 1e-8


def sinogram(slices: DataFrame, step: float = 1.0, chunk: int = 16) -> DataFrame:
    """Radon transform of each whole slice over -180..180 degrees, scaled to [0, 1] plus ``FLOOR``; a task for each chunk of angles; rows are angles."""
    angles = np.arange(-180.0, 180.0, step).tolist()
    spark = slices.sparkSession
    table = spark.createDataFrame([(i // chunk, i, a) for i, a in enumerate(angles)], "part int, row int, angle double").groupBy("part").agg(F.collect_list(F.struct("row", "angle")).alias("angles"))
    work = slices.join(F.broadcast(table)).repartition("slice_id", "part")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                a = to_diagonal(np.asarray(r["values"], float).reshape(r["height"], r["width"]))
                for s in r["angles"]:
                    v = rotate(a, s["angle"]).sum(0)
                    n = len(v)
                    yield pa.RecordBatch.from_arrays([pa.array([r["slice_id"]] * n, pa.int32()), pa.array([s["row"]] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), pa.array(v)], names=["slice_id", "row", "col", "value"])

    from ..operators.pointwise import minmax_slice

    return minmax_slice(work.select("slice_id", "height", "width", "values", "angles").mapInArrow(run, "slice_id int, row int, col int, value double")).select("slice_id", "row", "col", (F.col("value") + FLOOR).alias("value"))


def detector_gain(pixels: DataFrame, low: float = 0.9, high: float = 1.1, error: float = 0.0, seed: int = 42) -> DataFrame:
    """Pixels times a gain of each column in U(low, high) with a normal error by pixel, scaled anew plus ``FLOOR``; and the gain itself.

    Numbers come from hashes of the place, so any task repeats them."""
    def u(*cols):
        return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    gain = low + (high - low) * u(F.lit(seed), "slice_id", "col")
    normal = F.sqrt(-2 * F.log(u(F.lit(seed + 1), "slice_id", "row", "col"))) * F.cos(2 * np.pi * u(F.lit(seed + 2), "slice_id", "row", "col"))
    from ..operators.pointwise import minmax_slice

    whole = gain + (gain * error * normal if error else F.lit(0.0))
    out = pixels.select("slice_id", "row", "col", (F.col("value") * whole).alias("value"))
    return minmax_slice(out).select("slice_id", "row", "col", (F.col("value") + FLOOR).cast("float").alias("value"), whole.cast("float").alias("gain"))


def convolve(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Circular convolution; the kernel's first element is its origin."""
    return np.fft.ifft2(np.fft.fft2(a) * np.fft.fft2(kernel, a.shape)).real


def _spread(n: int, sigma: float) -> np.ndarray:
    """A Gaussian of sum 1 about n div 2 in n places, cut at four sigma and mirrored at the ends."""
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / max(sigma, 1e-12)) ** 2)
    at = (n // 2 + np.arange(-r, r + 1)) % (2 * n)
    return np.bincount(np.minimum(at, 2 * n - 1 - at), w / w.sum(), n)


def synthetic_noise(shape: tuple[int, int], white: float = 1.0, streak: float = 1.0, sigma: tuple[float, float] = (50.0, 1.0), seed: int = 0) -> np.ndarray:
    """White noise and streaks made of the same field, by a point and by the same point blurred by ``sigma``, both at the image's centre."""
    field = np.random.default_rng(seed).normal(size=shape)
    point = np.zeros(shape)
    point[shape[0] // 2, shape[1] // 2] = 1
    return white * convolve(field, point) + streak * convolve(field, np.outer(_spread(shape[0], sigma[0]), _spread(shape[1], sigma[1])))


def benchmark_sinogram(size: int = 512, snr_db: float = 5.0, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(clean, noisy): two blobs, smoothed random column offsets, and noise at a signal-to-noise ratio."""
    from ..functions import taps as tp
    from ..kernels.images import filter_axis

    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:size, :size] / size
    clean = np.exp(-((x - 0.35) ** 2 + (y - 0.4) ** 2) / 0.02) + 0.7 * np.exp(-((x - 0.65) ** 2 + (y - 0.6) ** 2) / 0.03)
    offsets = filter_axis(rng.normal(size=(1, size)), tp.gaussian(1.0), 1)[0] * 0.2
    noise = rng.normal(size=clean.shape)
    noise *= np.sqrt(clean.var() / 10 ** (snr_db / 10)) / noise.std()
    return clean, clean + offsets + noise


def to_slices(spark: SparkSession, stack: np.ndarray) -> DataFrame:
    """A 2-D or 3-D array of the driver as slices, through Arrow; float32 stays single precision."""
    import pyarrow as pa

    stack = stack[None] if stack.ndim == 2 else stack
    stack = np.ascontiguousarray(stack, np.float32 if stack.dtype == np.float32 else np.float64)
    n, h, w = stack.shape
    values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (h * w)), pa.array(stack.ravel()))
    return spark.createDataFrame(pa.table({"slice_id": pa.array(np.arange(n), pa.int32()), "height": pa.array([h] * n, pa.int32()), "width": pa.array([w] * n, pa.int32()), "values": values}))


def from_npy(spark: SparkSession, path: str) -> DataFrame:
    return to_slices(spark, np.load(path))
