"""Projections and filters over pixels: normalising, windows, profiles, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import V, finite

KEYS = ["slice_id", "row", "col"]


def minmax_slice(pixels: DataFrame) -> DataFrame:
    """(v - min) / (max - min) of each slice; 0 where the range is 1e-10 or less.  min and max stay for the way back."""
    ends = pixels.groupBy("slice_id").agg(F.min(V()).alias("lo"), F.max(V()).alias("hi"))
    span = F.col("hi") - F.col("lo")
    return pixels.join(ends, "slice_id").select(*KEYS, F.when(span > 1e-10, (V() - F.col("lo")) / span).otherwise(0.0).alias("value"), "lo", "hi")


def minmax_stack(pixels: DataFrame) -> DataFrame:
    """The same over all slices together (one row of ends); unscaled where all values are equal."""
    ends = pixels.agg(F.min(V()).alias("lo"), F.max(V()).alias("hi"))
    span = F.col("hi") - F.col("lo")
    return pixels.join(F.broadcast(ends)).select(*KEYS, F.when(span > 0, (V() - F.col("lo")) / span).otherwise(V()).alias("value"), "lo", "hi")


def denormalize(normal: DataFrame) -> DataFrame:
    return normal.select(*KEYS, F.when(F.col("hi") - F.col("lo") > 1e-10, V() * (F.col("hi") - F.col("lo")) + F.col("lo")).otherwise(F.col("lo")).alias("value"))


def window_level(pixels: DataFrame, low: float, high: float) -> DataFrame:
    """(v - low) / (high - low), clamped; 0.5 if the window is empty."""
    x = F.lit(0.5) if high <= low else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (V() - low) / (high - low)))
    return pixels.select(*KEYS, x.alias("value"))


def grayscale_u8(pixels: DataFrame) -> DataFrame:
    """0..255 between the finite ends of the slice, truncated; non-finite values and constant slices are 0."""
    ends = pixels.filter(finite()).groupBy("slice_id").agg(F.min(V()).alias("lo"), F.max(V()).alias("hi"))
    span = F.col("hi") - F.col("lo")
    x = F.when(finite() & (span > 0), ((V() - F.col("lo")) / span * 255).cast("int")).otherwise(0)
    return pixels.join(ends, "slice_id", "left").select(*KEYS, x.alias("value"))


def percentile_stretch(pixels: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """8-bit stretch between two percentiles of the slice."""
    ends = pixels.groupBy("slice_id").agg(F.percentile(V(), F.lit(low)).alias("lo"), F.percentile(V(), F.lit(high)).alias("hi"))
    span = F.col("hi") - F.col("lo")
    x = F.when(span > 0, (F.greatest(F.lit(0.0), F.least(F.lit(1.0), (V() - F.col("lo")) / span)) * 255).cast("int")).otherwise(0)
    return pixels.join(ends, "slice_id").select(*KEYS, x.alias("value"))


def subtract_profile(pixels: DataFrame, profile: DataFrame) -> DataFrame:
    """Each row minus the profile (slice_id, col, value): an equi-join; columns without a profile keep their values."""
    p = profile.select("slice_id", "col", F.col("value").alias("_p"))
    return pixels.join(p, ["slice_id", "col"], "left").select(*KEYS, (V() - F.coalesce("_p", F.lit(0.0))).alias("value"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEYS, V().alias("x")).join(b.select(*KEYS, V().alias("y")), KEYS).select(*KEYS, (F.col("x") - F.col("y")).alias("value"))


def even_columns(pixels: DataFrame, n: int) -> DataFrame:
    """n columns at i * (width - 1) div (n - 1), renumbered; all of them if there are no more than n."""
    width = pixels.groupBy("slice_id").agg((F.max("col") + 1).alias("w"))
    at = width.select("slice_id", "w", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    spread = F.floor(F.col("i") * (F.col("w") - 1) / max(1, n - 1))
    picked = at.select("slice_id", F.col("i").alias("new_col"), F.when(F.col("w") > n, spread).otherwise(F.col("i")).cast("int").alias("col"))
    return pixels.join(picked, ["slice_id", "col"]).select("slice_id", "row", F.col("new_col").alias("col"), "value")


def tile_profile(profile: DataFrame, height: int) -> DataFrame:
    """A profile as an image of ``height`` equal rows."""
    return profile.select("slice_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("row"), "col", "value")


def pixel_at(pixels: DataFrame, slice_id: int, x: int, y: int) -> DataFrame:
    return pixels.filter((F.col("slice_id") == slice_id) & (F.col("row") == y) & (F.col("col") == x))


def soft_gate(profile: DataFrame, sigma: float, alpha: float = 0.0, energy: DataFrame | None = None) -> DataFrame:
    """x / (1 + (|x| / t) ** 6) with t = 3 sigma (1 + alpha energy); 0 where t is 1e-10 or less."""
    p = profile
    t = F.lit(3.0 * sigma)
    if energy is not None:
        p = p.join(energy.select("slice_id", "col", F.col("value").alias("_e")), ["slice_id", "col"])
        t = t * (1 + F.lit(alpha) * F.col("_e"))
    return p.select("slice_id", "col", F.when(t > 1e-10, V() / (1 + F.pow(F.abs(V()) / t, 6))).otherwise(0.0).alias("value"))


def diverging_range(pixels: DataFrame) -> DataFrame:
    """Symmetric range of a difference view: -m..m with m the largest finite magnitude."""
    return pixels.filter(finite()).groupBy("slice_id").agg((-F.max(F.abs(V()))).alias("lo"), F.max(F.abs(V())).alias("hi"))


def colors_at(levels: DataFrame, table: DataFrame) -> DataFrame:
    """Pixels with a level 0..255 through a table (level, red, green, blue) of 256 rows."""
    return levels.join(F.broadcast(table), "level").select(*KEYS, "red", "green", "blue")


def _level(x):
    return F.greatest(F.lit(0), F.least(F.lit(255), (x * 255).cast("int"))).alias("level")


def colormap(normal: DataFrame, table: DataFrame) -> DataFrame:
    """Values in 0..1 through a table of 256 levels; levels are truncated."""
    return colors_at(normal.select(*KEYS, _level(V())), table)


def grayscale_table(spark) -> DataFrame:
    i = F.col("id").cast("int")
    return spark.range(256).select(i.alias("level"), i.alias("red"), i.alias("green"), i.alias("blue"))


# Colours (red, green, blue) at 0, 1/4, 1/2, 3/4 and 1 of the sequential maps.
SEQUENTIAL = {
    "viridis": ((68, 1, 84), (49, 54, 149), (53, 183, 121), (180, 222, 44), (253, 231, 37)),
    "inferno": ((0, 0, 4), (87, 16, 110), (188, 55, 84), (249, 142, 9), (252, 255, 164)),
    "plasma": ((13, 8, 135), (126, 3, 168), (204, 71, 120), (248, 149, 64), (240, 249, 33)),
}
# Lowest, middle and highest colour of the diverging map.
DIVERGING = ((33, 102, 172), (255, 255, 255), (255, 58, 56))


def sequential_table(spark, name: str) -> DataFrame:
    """Linear between the five colours of a map, truncated."""
    points, t = SEQUENTIAL[name], F.col("id") / 255.0

    def channel(c: int):
        piece = [points[k][c] + (t - k / 4) / 0.25 * (points[k + 1][c] - points[k][c]) for k in range(4)]
        return F.when(t < 0.25, piece[0]).when(t < 0.5, piece[1]).when(t < 0.75, piece[2]).otherwise(piece[3]).cast("int")

    return spark.range(256).select(F.col("id").cast("int").alias("level"), *[channel(c).alias(n) for c, n in enumerate(("red", "green", "blue"))])


def diverging_table(spark) -> DataFrame:
    """Blue at -1 over white at 0 to red at 1, linear on each side, truncated."""
    t = F.col("id") / 255.0 * 2 - 1
    low, middle, high = DIVERGING
    channel = lambda c: F.when(t < 0, low[c] + (1 + t) * (middle[c] - low[c])).otherwise(middle[c] - t * (middle[c] - high[c])).cast("int")
    return spark.range(256).select(F.col("id").cast("int").alias("level"), *[channel(c).alias(n) for c, n in enumerate(("red", "green", "blue"))])


def diverging_colors(pixels: DataFrame) -> DataFrame:
    """A difference image in diverging colours over the symmetric range of its slice."""
    m = diverging_range(pixels).select("slice_id", F.col("hi").alias("_m"))
    share = F.when(F.col("_m") > 0, V() / F.col("_m")).otherwise(0.0)
    return colors_at(pixels.join(m, "slice_id").select(*KEYS, _level((share + 1) * 0.5)), diverging_table(pixels.sparkSession))


def sequential_colors(pixels: DataFrame, name: str) -> DataFrame:
    return colormap(minmax_slice(pixels), sequential_table(pixels.sparkSession, name))
