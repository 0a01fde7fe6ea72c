"""Aggregations over pixels (slice_id, row, col, value): all are partial/final aggregates or joins with small results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def V() -> Column:
    return F.col("value").cast("double")



def finite(c: Column | str = "value") -> Column:
    x = F.col(c).cast("double") if isinstance(c, str) else c
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def roi(pixels: DataFrame, min_x: int, min_y: int, max_x: int, max_y: int) -> DataFrame:
    """Inclusive rectangle; a range filter that reaches the scan."""
    return pixels.filter(F.col("col").between(min_x, max_x) & F.col("row").between(min_y, max_y))


def image_stats(pixels: DataFrame) -> DataFrame:
    """min, max, mean, std (n - 1) and count of the finite values of each slice; mean and std are 0 for none."""
    agg = pixels.filter(finite()).groupBy("slice_id").agg(F.min(V()).alias("min_value"), F.max(V()).alias("max_value"), F.avg(V()).alias("mean_value"), F.coalesce(F.stddev_samp(V()), F.lit(0.0)).alias("std_value"), F.count("*").alias("n"))
    return agg


def histogram(pixels: DataFrame, bins: int = 64) -> DataFrame:
    """Equal bins over [min, max], the last closed; counts and counts over the largest count.  A constant slice has one bin of 1."""
    good = pixels.filter(finite())
    ends = good.groupBy("slice_id").agg(F.min(V()).alias("lo"), F.max(V()).alias("hi"))
    span = F.col("hi") - F.col("lo")
    at = F.when(span > 0, F.least(F.floor((V() - F.col("lo")) / (span / bins)), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = good.join(ends, "slice_id").groupBy("slice_id", at.alias("bin")).agg(F.count("*").alias("n"))
    top = counts.groupBy("slice_id").agg(F.max("n").alias("top"))
    return counts.join(top, "slice_id").select("slice_id", "bin", "n", (F.col("n") / F.col("top")).alias("height"))


def empirical_cdf(pixels: DataFrame) -> DataFrame:
    """Values in order with p = i / (n - 1)."""
    w = Window.partitionBy("slice_id")
    ranked = pixels.select("slice_id", V().alias("value"), F.row_number().over(w.orderBy(V())).alias("i"), F.count("*").over(w).alias("n"))
    return ranked.select("slice_id", "i", "value", F.when(F.col("n") > 1, (F.col("i") - 1) / (F.col("n") - 1)).otherwise(0.0).alias("p"))


def column_median(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("slice_id", "col").agg(F.median(V()).alias("value"))


def upper_median(values: Column) -> Column:
    """sorted[n / 2] of an array: the larger of the middle two for even n."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def column_upper_median(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("slice_id", "col").agg(F.collect_list(V()).alias("v")).select("slice_id", "col", upper_median(F.col("v")).alias("value"))


def column_variance_about_median(pixels: DataFrame) -> DataFrame:
    """Mean squared distance from the upper median of each column, in one aggregation."""
    packed = pixels.groupBy("slice_id", "col").agg(F.collect_list(V()).alias("v")).withColumn("med", upper_median(F.col("v")))
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + (x - F.col("med")) * (x - F.col("med")))
    return packed.select("slice_id", "col", F.col("med").alias("median"), (total / F.size("v")).alias("variance"))


def centre_bias(pixels: DataFrame) -> DataFrame:
    """Mean column variance of the middle half over that of the outer quarters."""
    var = pixels.groupBy("slice_id", "col").agg(F.var_pop(V()).alias("v"))
    width = var.groupBy("slice_id").agg((F.max("col") + 1).alias("w"))
    q = F.floor(F.col("w") / 4)
    outer = (F.col("col") < q) | (F.col("col") >= F.col("w") - q)
    found = var.join(width, "slice_id").groupBy("slice_id").agg(F.avg(F.when(~outer, F.col("v"))).alias("centre"), F.avg(F.when(outer, F.col("v"))).alias("edge"))
    return found.select("slice_id", "centre", "edge", F.when(F.col("edge") > 0, F.col("centre") / F.col("edge")).alias("ratio"))


def mad(pixels: DataFrame) -> DataFrame:
    """Median of the distances from the median, true medians."""
    med = pixels.groupBy("slice_id").agg(F.median(V()).alias("med"))
    return pixels.join(med, "slice_id").groupBy("slice_id").agg(F.first("med").alias("median"), F.median(F.abs(V() - F.col("med"))).alias("mad"))


def _upper(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Upper median of large groups by rank (an external sort), where an array would not fit."""
    w = Window.partitionBy(*keys)
    ranked = rows.select(*keys, value.alias("_v"), F.row_number().over(w.orderBy(value)).alias("_i"), F.count("*").over(w).alias("_n"))
    return ranked.filter(F.col("_i") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col("_v").alias(name))


def robust_sigma(pixels: DataFrame) -> DataFrame:
    """Upper-median MAD / 0.6745; the sample deviation where that is 0."""
    med = _upper(pixels, ["slice_id"], V(), "med")
    dev = pixels.join(med, "slice_id").select("slice_id", F.abs(V() - F.col("med")).alias("d"))
    found = _upper(dev, ["slice_id"], F.col("d"), "mad").join(pixels.groupBy("slice_id").agg(F.stddev_samp(V()).alias("sd")), "slice_id")
    return found.select("slice_id", F.when(F.col("mad") > 0, F.col("mad") / 0.6745).otherwise(F.coalesce("sd", F.lit(0.0))).alias("sigma"))


def column_mean_abs(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("slice_id", "col").agg(F.avg(F.abs(V())).alias("value"))


def error_metrics(a: DataFrame, b: DataFrame, data_range: float | None = None) -> DataFrame:
    """MAE, MSE and PSNR of two stacks on equal pixels; the range is that of ``a`` unless given."""
    keys = ["slice_id", "row", "col"]
    both = a.select(*keys, V().alias("x")).join(b.select(*keys, V().alias("y")), keys)
    agg = both.groupBy("slice_id").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"), F.avg(F.pow(F.col("x") - F.col("y"), 2)).alias("mse"), (F.max("x") - F.min("x")).alias("span"))
    span = F.lit(data_range) if data_range else F.col("span")
    return agg.select("slice_id", "mae", "mse", F.when(F.col("mse") > 0, 10 * F.log10(span * span / F.col("mse"))).alias("psnr"))


def column_argmax(profile: DataFrame) -> DataFrame:
    return profile.groupBy("slice_id").agg(F.max_by("col", "value").alias("col"), F.max("value").alias("value"))


def stats_counters(found: DataFrame, name: str = "stage"):
    """Counters of a stage as an observation, merged by Spark over all tasks."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return found.observe(seen, F.count("*").alias("rows")), seen
