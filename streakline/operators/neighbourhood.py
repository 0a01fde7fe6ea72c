"""Neighbourhood operators over pixels: separable filters, running medians, block matching, binning, overlap-add."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import taps as tp
from ..kernels.images import HADAMARD_8
from ..kernels.images import running_median as running
from ..sources import views as vw
from . import stats as st
from .pointwise import KEYS, subtract_profile


def filter_along_columns(pixels: DataFrame, taps, boundary=tp.reflect_index, radius: int | None = None) -> DataFrame:
    """Each image row filtered along its columns: one shuffle into rows, then whole batches of arrays at once."""
    return vw.from_rows(vw.map_rows(vw.to_rows(pixels), lambda a: tp.filter_rows(a, taps, boundary, radius)))


def filter_along_rows(pixels: DataFrame, taps, boundary=tp.reflect_index, radius: int | None = None) -> DataFrame:
    return vw.from_columns(vw.map_rows(vw.to_columns(pixels), lambda a: tp.filter_rows(a, taps, boundary, radius)))


def gaussian_rows(pixels: DataFrame, sigma: float) -> DataFrame:
    return filter_along_columns(pixels, tp.gaussian(sigma))


def gaussian_2d(pixels: DataFrame, sigma_y: float, sigma_x: float) -> DataFrame:
    return filter_along_rows(filter_along_columns(pixels, tp.gaussian(sigma_x)), tp.gaussian(sigma_y))


def db3_highpass(pixels: DataFrame) -> DataFrame:
    return filter_along_columns(pixels, tp.DB3_HIGH, tp.clamp_index, 3)


def fir_db3_robust(pixels: DataFrame, taps=tp.DB3_ROBUST) -> DataFrame:
    """Vertical Gaussian of sigma 2 and horizontal db3, both with clamped edges."""
    return filter_along_columns(filter_along_rows(pixels, tp.gaussian(2.0), tp.clamp_index), taps, tp.clamp_index, 3)


def profile_filter(profile: DataFrame, taps, boundary=tp.reflect_index, radius: int | None = None) -> DataFrame:
    """A profile (slice_id, col, value) filtered along its columns."""
    as_row = profile.select("slice_id", F.lit(0).alias("row"), "col", "value")
    return filter_along_columns(as_row, taps, boundary, radius).select("slice_id", "col", "value")


def running_median(profile: DataFrame, width: int) -> DataFrame:
    """Median of an odd window with replicated edges."""
    rows = vw.to_rows(profile.select("slice_id", F.lit(0).alias("row"), "col", "value"))
    return vw.from_rows(vw.map_rows(rows, lambda a: np.stack([running(v, width) for v in a]))).select("slice_id", "col", "value")


def streak_profile(pixels: DataFrame, sigma_smooth: float = 3.0, iterations: int = 1) -> DataFrame:
    """Column profile of streaks: blur, take the residual's column median, blur that, subtract, repeat."""
    current, total = pixels, None
    for _ in range(iterations):
        smooth = gaussian_2d(current, sigma_smooth, 3.0).select(*KEYS, F.col("value").alias("_s"))
        residual = current.join(smooth, KEYS).select(*KEYS, (st.V() - F.col("_s")).alias("value"))
        step = profile_filter(st.column_median(residual), tp.gaussian(1.0))
        total = step if total is None else total.unionByName(step).groupBy("slice_id", "col").agg(F.sum("value").alias("value"))
        current = subtract_profile(current, step)
    return total


def sigma_profile(pixels: DataFrame, smoothing: float = 20.0, scale: float = 1.1) -> DataFrame:
    """|profile - blurred profile| * scale, of one iteration with sigma 5."""
    p = streak_profile(pixels, 5.0, 1)
    blurred = profile_filter(p, tp.gaussian(smoothing)).select("slice_id", "col", F.col("value").alias("_b"))
    return p.join(blurred, ["slice_id", "col"]).select("slice_id", "col", (F.abs(F.col("value") - F.col("_b")) * scale).alias("value"))


def remove_streak_profile(pixels: DataFrame, sigma_smooth: float = 3.0, iterations: int = 1) -> DataFrame:
    return subtract_profile(pixels, streak_profile(pixels, sigma_smooth, iterations))


def integral_image(pixels: DataFrame) -> DataFrame:
    """Sums over all pixels up to (row, col), of values and of squares: a prefix along each row, then down each column."""
    across = Window.partitionBy("slice_id", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("slice_id", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    first = pixels.select(*KEYS, F.sum(st.V()).over(across).alias("s"), F.sum(st.V() * st.V()).over(across).alias("q"))
    return first.select(*KEYS, F.sum("s").over(down).alias("total"), F.sum("q").over(down).alias("squares"))


def patch_sums(pixels: DataFrame, patch: int = 8) -> DataFrame:
    """Sum of each whole patch by its top-left pixel: two sliding sums."""
    across = Window.partitionBy("slice_id", "row").orderBy("col").rowsBetween(0, patch - 1)
    down = Window.partitionBy("slice_id", "col").orderBy("row").rowsBetween(0, patch - 1)
    first = pixels.select(*KEYS, F.sum(st.V()).over(across).alias("s"), F.count("*").over(across).alias("n"))
    both = first.filter(F.col("n") == patch).select(*KEYS, F.sum("s").over(down).alias("value"), F.count("*").over(down).alias("m"))
    return both.filter(F.col("m") == patch).select(*KEYS, "value")


def patch_table(pixels: DataFrame, patch: int, step: int) -> DataFrame:
    """(slice_id, row, col, patch): row-major arrays of the patches whose corner lies on the grid."""
    run = F.collect_list("value").over(Window.partitionBy("slice_id", "row").orderBy("col").rowsBetween(0, patch - 1))
    strips = pixels.select("slice_id", "row", "col", run.alias("s")).filter((F.col("col") % step == 0) & (F.size("s") == patch))
    block = F.collect_list("s").over(Window.partitionBy("slice_id", "col").orderBy("row").rowsBetween(0, patch - 1))
    found = strips.select("slice_id", "row", "col", block.alias("b")).filter((F.col("row") % step == 0) & (F.size("b") == patch))
    return found.select("slice_id", "row", "col", F.flatten("b").alias("patch"))


def match_patches(pixels: DataFrame, patch: int = 8, step: int = 4, window: int = 24, matches: int = 16) -> DataFrame:
    """The ``matches`` most similar patches around each reference on the grid, itself first, ties by place.

    Candidates lie on the grid (the window is a multiple of 2 * step), so each reference is sent to its
    neighbouring grid places by arithmetic: an equi-join, not a range join."""
    if (window // 2) % step:
        raise ValueError("half the window must be a multiple of the step")
    grid = patch_table(pixels, patch, step)
    reach = window // 2 // step
    d = F.sequence(F.lit(-reach), F.lit(reach))
    places = F.flatten(F.transform(d, lambda y: F.transform(d, lambda x: F.struct((F.col("row") + y * step).alias("r"), (F.col("col") + x * step).alias("c")))))
    refs = grid.select("slice_id", F.col("row").alias("ref_row"), F.col("col").alias("ref_col"), F.col("patch").alias("ref"), F.explode(places).alias("at"))
    refs = refs.select("slice_id", "ref_row", "ref_col", "ref", F.col("at.r").alias("row"), F.col("at.c").alias("col"))
    dist = F.aggregate(F.zip_with("ref", "patch", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)
    own = (F.col("row") == F.col("ref_row")) & (F.col("col") == F.col("ref_col"))
    pairs = refs.join(grid, ["slice_id", "row", "col"]).select("slice_id", "ref_row", "ref_col", "row", "col", dist.alias("distance"), own.alias("own"))
    order = Window.partitionBy("slice_id", "ref_row", "ref_col").orderBy(F.desc("own"), "distance", "row", "col")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= matches).drop("own")


def overlap_add(blocks: DataFrame, fallback: DataFrame) -> DataFrame:
    """Weighted blocks (slice_id, row, col, value, weight) over a fallback image: sum(w v) / sum(w) where that is over 1e-6."""
    sums = blocks.groupBy(*KEYS).agg(F.sum(F.col("value") * F.col("weight")).alias("num"), F.sum("weight").alias("den"))
    return fallback.join(sums, KEYS, "left").select(*KEYS, F.when(F.col("den") > 1e-6, F.col("num") / F.col("den")).otherwise(st.V()).alias("value"))


def bin_horizontal(pixels: DataFrame) -> DataFrame:
    """Sums of neighbouring column pairs; an odd last column counts twice."""
    width = pixels.groupBy("slice_id").agg((F.max("col") + 1).alias("w"))
    weight = F.when((F.col("w") % 2 == 1) & (F.col("col") == F.col("w") - 1), 2.0).otherwise(1.0)
    return pixels.join(width, "slice_id").groupBy("slice_id", "row", F.floor(F.col("col") / 2).cast("int").alias("col")).agg(F.sum(st.V() * weight).alias("value"))


def apply_column_matrix(pixels: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Rows times a small matrix (old columns x new columns): a join with its non-zero entries."""
    i, j = np.nonzero(matrix)
    spark = pixels.sparkSession
    table = spark.createDataFrame([(int(a), int(b), float(matrix[a, b])) for a, b in zip(i, j, strict=True)], "col int, new_col int, m double")
    return pixels.join(table, "col").groupBy("slice_id", "row", F.col("new_col").alias("col")).agg(F.sum(st.V() * F.col("m")).alias("value"))


def cluster_gate(profile: DataFrame, sigma: float, low: float = 0.5, high: float = 8.0, width: int = 20) -> DataFrame:
    """Runs of |value| > low * sigma that are wider than ``width`` and peak over high * sigma become 0 (gaps and islands)."""
    w = Window.partitionBy("slice_id").orderBy("col")
    on = F.abs("value") > low * sigma
    runs = profile.withColumn("on", on).withColumn("island", F.sum((~F.col("on")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = runs.filter("on").groupBy("slice_id", "island").agg(F.count("*").alias("n"), F.max(F.abs("value")).alias("peak"))
    walls = size.filter((F.col("n") > width) & (F.col("peak") > high * sigma)).select("slice_id", "island", F.lit(True).alias("wall"))
    found = runs.join(walls, ["slice_id", "island"], "left")
    return found.select("slice_id", "col", F.when(F.col("on") & F.col("wall"), 0.0).otherwise(F.col("value")).alias("value"))


def coarse_max_variance(pixels: DataFrame, scale: int) -> DataFrame:
    """Largest fine column variance under each coarse column."""
    fine = st.column_variance_about_median(pixels)
    return fine.groupBy("slice_id", F.shiftright("col", scale).alias("col")).agg(F.max("variance").alias("value"))


def saliency_gate(residual: DataFrame, fine: DataFrame, scale: int, sigma: float) -> DataFrame:
    """Column median times its score**8, the score med^2 / (med^2 + var), 0 over noisy fine columns."""
    col = st.column_variance_about_median(residual)
    fine_var = coarse_max_variance(fine, scale).select("slice_id", "col", F.col("value").alias("fine"))
    m2 = F.col("median") * F.col("median")
    score = F.when((m2 + F.col("variance") > 0) & (F.col("fine") <= 2 * sigma * sigma), m2 / (m2 + F.col("variance"))).otherwise(0.0)
    return col.join(fine_var, ["slice_id", "col"]).select("slice_id", "col", (F.col("median") * F.pow(score, 8)).alias("value"))


def power_iteration(pixels: DataFrame, rounds: int = 20) -> DataFrame:
    """Right vector of the largest singular value from a constant start: two aggregations a round."""
    width = pixels.groupBy("slice_id").agg(F.count_distinct("col").alias("w"))
    v = pixels.select("slice_id", "col").distinct().join(width, "slice_id").select("slice_id", "col", (1 / F.sqrt("w")).alias("v"))

    def unit(df: DataFrame, key: str, name: str) -> DataFrame:
        norm = F.sqrt(F.sum(F.col(name) * F.col(name)).over(Window.partitionBy("slice_id")))  # one value per row or column of a slice
        return df.select("slice_id", key, (F.col(name) / norm).alias(name), norm.alias("norm"))

    for k in range(rounds):
        u = unit(pixels.join(v.select("slice_id", "col", "v"), ["slice_id", "col"]).groupBy("slice_id", "row").agg(F.sum(st.V() * F.col("v")).alias("u")), "row", "u")
        v = unit(pixels.join(u.select("slice_id", "row", "u"), ["slice_id", "row"]).groupBy("slice_id", "col").agg(F.sum(st.V() * F.col("u")).alias("v")), "col", "v")
        if k % 5 == 4 and pixels.sparkSession.sparkContext.getCheckpointDir():
            v = v.checkpoint()
    return v.select("slice_id", "col", F.col("v").alias("value"), F.col("norm").alias("singular_value"))


def dft_rows(pixels: DataFrame, n: int = 8) -> DataFrame:
    """Discrete Fourier transform of each whole block of ``n`` columns of each row, as (re, im) at the block's columns."""
    rows = vw.to_rows(pixels)

    def both(a: np.ndarray) -> np.ndarray:
        z = np.fft.fft(a[:, : a.shape[1] // n * n].reshape(len(a), -1, n))
        return np.stack([z.real, z.imag], -1).reshape(len(a), -1)

    at = vw.map_rows(rows, both).select("slice_id", "row", F.posexplode("values").alias("at", "v"))
    col = F.floor(F.col("at") / 2).cast("int").alias("col")
    part = lambda k: F.max(F.when(F.col("at") % 2 == k, F.col("v")))
    return at.groupBy("slice_id", "row", col).agg(part(0).alias("re"), part(1).alias("im"))


def wht_patches(pixels: DataFrame) -> DataFrame:
    """2-D Walsh-Hadamard transform (natural order, not normalised) of each whole 8 x 8 block, at the block's pixels."""

    def across(a: np.ndarray) -> np.ndarray:
        return (a[:, : a.shape[1] // 8 * 8].reshape(len(a), -1, 8) @ HADAMARD_8).reshape(len(a), -1)

    once = vw.from_rows(vw.map_rows(vw.to_rows(pixels), across))
    return vw.from_columns(vw.map_rows(vw.to_columns(once), across))
