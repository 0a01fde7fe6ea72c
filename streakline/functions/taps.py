"""Filter taps, boundary rules and small numeric rules shared by SQL operators and kernels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# db3 high-pass taps of the two noise estimators (the second keeps its published signs, which do not sum to 0).
DB3_HIGH = (-0.33267055, 0.80689151, -0.45987750, -0.13501102, 0.08544127, 0.03522629)
DB3_ROBUST = (0.03522629, -0.08544127, 0.13501102, 0.45987750, -0.80689151, 0.33267055)
DB3_ZERO_MEAN = tuple(-x for x in reversed(DB3_HIGH))


def gaussian(sigma: float) -> list[float]:
    """Normalised taps of radius ceil(4 sigma); one tap of 1 for sigma 0 or less."""
    if sigma <= 0:
        return [1.0]
    r = math.ceil(4 * sigma)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return (w / w.sum()).tolist()


def reflect_index(i: np.ndarray, n: int) -> np.ndarray:
    """Left edge mirrored with its sample, right edge without."""
    left, right = np.minimum(-i - 1, n - 1), np.maximum(n - 2 - (i - n), 0)
    return np.where(i < 0, left, np.where(i >= n, right, i))


def clamp_index(i: np.ndarray, n: int) -> np.ndarray:
    return np.clip(i, 0, n - 1)


def filter_rows(a: np.ndarray, taps, boundary=reflect_index, radius: int | None = None) -> np.ndarray:
    """Correlation of each row with taps; ``boundary`` maps indices beyond the ends."""
    n, r = a.shape[1], len(taps) // 2 if radius is None else radius
    if not n:
        return np.zeros_like(a, dtype=np.result_type(a, np.float32))
    return filter_valid(np.take(a, boundary(np.arange(-r, n + len(taps) - 1 - r), n), axis=1), taps)


def filter_valid(wide: np.ndarray, taps) -> np.ndarray:
    """Correlation along the last axis, where all taps have a value."""
    n = wide.shape[-1] - len(taps) + 1
    out = np.zeros((*wide.shape[:-1], n), np.result_type(wide, np.float32))
    part = np.empty_like(out)
    for k, w in enumerate(taps):
        out += np.multiply(wide[..., k : k + n], out.dtype.type(w), out=part)
    return out


def filter_down(a: np.ndarray, taps, boundary=reflect_index) -> np.ndarray:
    """Correlation along the last axis but one, by whole rows."""
    n, r = a.shape[-2], len(taps) // 2
    wide = np.take(a, boundary(np.arange(-r, n + r), n), axis=-2)
    out = np.zeros_like(a, dtype=np.result_type(a, np.float32))
    part = np.empty_like(out)
    for k, w in enumerate(taps):
        out += np.multiply(wide[..., k : k + n, :], out.dtype.type(w), out=part)
    return out


def natural_key(name: Column) -> Column:
    """Sort key of a file name: digit runs as numbers before texts, texts in lower case."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike(r"^\d"), 0).otherwise(1).alias("kind"), F.when(p.rlike(r"^\d"), p.cast("decimal(38,0)")).alias("number"), F.when(p.rlike(r"^\d"), "").otherwise(p).alias("text")))


def number_of_scales(width: int) -> int:
    return 0 if width <= 40 else min(3, int(math.floor(math.log2(width / 40))))


def anisotropic_psd(patch: int, width: float = 0.6) -> np.ndarray:
    y = np.arange(patch)
    return np.repeat(np.exp(-0.5 * (np.minimum(y, patch - y) / width) ** 2)[:, None], patch, 1)


def blend_window(patch: int) -> np.ndarray:
    s = np.sin(np.pi * (np.arange(patch) + 0.5) / patch)
    w = np.outer(s, s)
    return w / w.mean()
