"""Numeric kernels on one image (2-D arrays), used slice by slice inside Arrow steps and tested without Spark."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from ..functions import taps as tp


@dataclass(frozen=True)
class Params:
    sigma_random: float = 0.1
    patch: int = 8
    step: int = 4
    window: int = 24
    matches: int = 16
    threshold: float = 2.7
    streak_sigma: float = 3.0
    streak_iterations: int = 2
    map_smoothing: float = 20.0
    map_scale: float = 1.1
    psd_width: float = 0.6
    filter_strength: float = 1.0
    debin_iterations: int = 30
    hadamard: bool = False

    def checked(self) -> Params:
        if min(self.patch, self.step, self.window, self.matches) < 1 or self.threshold < 0 or self.sigma_random < 0 or self.filter_strength <= 0 or self.debin_iterations < 1:
            raise ValueError("sizes must be positive, and noise and threshold not negative")
        if self.hadamard and self.patch != 8:
            raise ValueError("the Hadamard path is for patches of 8")
        return self


clamp_index = tp.clamp_index


def filter_axis(a: np.ndarray, taps, axis: int, boundary=tp.reflect_index, radius: int | None = None) -> np.ndarray:
    return tp.filter_rows(a.T, taps, boundary, radius).T if axis == 0 else tp.filter_rows(a, taps, boundary, radius)


def blur(a: np.ndarray, sigma_y: float, sigma_x: float) -> np.ndarray:
    return filter_axis(filter_axis(a, tp.gaussian(sigma_x), 1), tp.gaussian(sigma_y), 0)


#: Values that a filter works on at a time: so few that they stay in the processor's cache.
BLOCK = 1 << 16


def residual_medians(a: np.ndarray, sigma_y: float, sigma_x: float = 3.0, strip: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """Column medians of an image less its blur, some columns at a time.

    Of a ``strip`` (from column, to column, the array's first column, the image's width) with the columns around it that the blur takes, those of its columns."""
    h, (begin, w, left, total) = a.shape[0], strip or (0, a.shape[1], 0, a.shape[1])
    across, down = tp.gaussian(sigma_x), tp.gaussian(sigma_y)
    r, out, n = len(across) // 2, np.zeros(w - begin), max(64, BLOCK // max(1, h))
    for c in range(begin, w, n):
        at = tp.reflect_index(np.arange(c - r, min(w, c + n) + r), total) - left
        part = a[:, at].astype(np.float64, copy=False)
        own = part[:, r : part.shape[1] - r]
        slow = tp.filter_down(tp.filter_valid(part, across), down)
        out[c - begin : c - begin + n] = np.median(own - slow, axis=0)
    return out


def streak_profile(a: np.ndarray, sigma: float = 3.0, iterations: int = 1) -> np.ndarray:
    """Streaks by column.  A profile that is taken from all rows shifts the medians by what the blur leaves of it, so one blur does for all iterations."""
    return profile_of(residual_medians(a, sigma), iterations)


def profile_of(medians: np.ndarray, iterations: int) -> np.ndarray:
    """``streak_profile`` of its residual medians."""
    total = np.zeros(len(medians))
    for _ in range(iterations):
        p = filter_axis(medians[None], tp.gaussian(1.0), 1)[0]
        total += p
        medians = medians - (p - filter_axis(p[None], tp.gaussian(3.0), 1)[0])
    return total


def sigma_profile(a: np.ndarray, smoothing: float = 20.0, scale: float = 1.1) -> np.ndarray:
    return levels_of(residual_medians(a, 5.0), smoothing, scale)


def levels_of(medians: np.ndarray, smoothing: float, scale: float) -> np.ndarray:
    """``sigma_profile`` of its residual medians."""
    p = profile_of(medians, 1)
    return np.abs(p - filter_axis(p[None], tp.gaussian(smoothing), 1)[0]) * scale


def running_median(v: np.ndarray, width: int) -> np.ndarray:
    r = width // 2
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(v, r, mode="edge"), width), axis=1)


def upper_median(v: np.ndarray, axis: int | None = None) -> np.ndarray:
    n = v.size if axis is None else v.shape[axis]
    return np.take(np.partition(v, n // 2, axis=axis), n // 2, axis=0 if axis is None else axis)


def mad(v: np.ndarray) -> float:
    return float(np.median(np.abs(v - np.median(v)))) if v.size else 0.0


def robust_sigma(v: np.ndarray) -> float:
    m = float(upper_median(np.abs(v - upper_median(v.ravel())).ravel()))
    return m / 0.6745 if m > 0 else float(v.std(ddof=1)) if v.size > 1 else 0.0


def recursive_gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Third-order recursive Gaussian down the columns and back (Young and van Vliet, 1995)."""
    sigma = max(sigma, 0.5)
    q = 0.98711 * sigma - 0.96330 if sigma >= 2.5 else 3.97156 - 4.14554 * np.sqrt(1 - 0.26891 * sigma)
    b = np.array([2.44413 * q + 2.85619 * q**2 + 1.26661 * q**3, -(1.4281 * q**2 + 1.26661 * q**3), 0.422205 * q**3]) / (1.57825 + 2.44413 * q + 1.4281 * q**2 + 0.422205 * q**3)
    gain = 1 - b.sum()

    def sweep(x: np.ndarray) -> np.ndarray:
        out, past = np.empty_like(x), [x[0]] * 3
        for i, row in enumerate(x):
            out[i] = gain * row + b[0] * past[0] + b[1] * past[1] + b[2] * past[2]
            past = [out[i], *past[:2]]
        return out

    return sweep(sweep(a.astype(np.float64))[::-1])[::-1]


def even_columns(width: int, n: int) -> np.ndarray:
    return np.arange(width) if width <= n else np.arange(n) * (width - 1) // max(1, n - 1)


def noise_sigma(a: np.ndarray, max_columns: int = 1024) -> float:
    if not a.size:
        return 0.0
    a = a[:, even_columns(a.shape[1], max_columns)] if max_columns else a
    return 1.4826 * mad(filter_axis(recursive_gaussian(a, a.shape[0] / 12), tp.DB3_HIGH, 1, clamp_index, 3))


def patch_sigma(a: np.ndarray, taps=tp.DB3_ROBUST) -> float:
    if min(a.shape) < 5:
        return 0.0
    return 3.96 * mad(filter_axis(filter_axis(a.astype(np.float64), tp.gaussian(2.0), 0, clamp_index), taps, 1, clamp_index, 3))


def patch_sigmas(patches: np.ndarray, taps=tp.DB3_ROBUST) -> np.ndarray:
    """``patch_sigma`` of many patches of one size, some at a time."""
    n, h, w = patches.shape
    out, some = np.empty(n), max(1, BLOCK // (h * w))
    for at in range(0, n, some):
        part = patches[at : at + some].astype(np.float64)
        down = tp.filter_down(part, tp.gaussian(2.0), clamp_index)
        flat = tp.filter_rows(down.reshape(-1, w), taps, clamp_index, 3).reshape(len(part), h * w)
        off = np.abs(flat - np.median(flat, axis=1, keepdims=True))
        out[at : at + some] = 3.96 * np.median(off, axis=1, overwrite_input=True)
    return out


def noise_sigma_robust(a: np.ndarray, taps=tp.DB3_ROBUST, size: int = 64) -> float:
    """Smallest positive noise level of the overlapping tiles; that of the whole image if there is none."""
    h, w = a.shape
    if h < 16 or w < 16:
        return 0.0
    rows, cols = np.arange(0, max(0, h - size), size // 2), np.arange(0, max(0, w - size), size // 2)
    if not len(rows) or not len(cols):
        return patch_sigma(a, taps)
    views = np.lib.stride_tricks.sliding_window_view(a, (size, size))
    found = np.concatenate([patch_sigmas(views[r, cols], taps) for r in rows])
    return float(found[found > 0].min(initial=np.inf)) if (found > 0).any() else patch_sigma(a, taps)


@dataclass(frozen=True)
class Tile:
    """Where an array stands in its image: the image's height and width, and the array's first row and column there."""

    height: int
    width: int
    top: int = 0
    left: int = 0


def _grid(first: int, n: int, total: int, p: Params) -> np.ndarray:
    """References along an axis (places in the image) whose candidates all lie in the part [first, first + n) of it."""
    at, half = np.arange(0, total - p.patch + 1, p.step), p.window // 2
    return at[(np.maximum(0, at - half) >= first) & (np.minimum(at + half, total - p.patch) + p.patch <= first + n)]


def _offsets(refs: np.ndarray, total: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Distances to candidates along an axis, and by reference which of them hold: from max(0, r - half) on by steps, to r + half at most."""
    half = p.window // 2
    off = np.union1d(np.arange(-half, half + 1, p.step), np.arange(-(half // p.step) * p.step, half + 1, p.step))
    first = np.maximum(0, refs - half) - refs
    rest = off[None] - first[:, None]
    return off, (rest >= 0) & (rest % p.step == 0) & (refs[:, None] + off[None] <= total - p.patch)


def match_grid(pilot: np.ndarray, rows: np.ndarray, cols: np.ndarray, p: Params, tile: Tile) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the references rows x cols (evenly spaced places in the image): rows, columns and distances of the matches, the reference first, -1 where there is none.

    One offset at a time: squared differences of the whole band, summed over patches that begin on the grid."""
    size, step = p.patch, p.step
    (dr, ok_r), (dc, ok_c) = _offsets(rows, tile.height, p), _offsets(cols, tile.width, p)
    n = len(rows) * len(cols)
    dist = np.full((len(dr) * len(dc), len(rows), len(cols)), np.inf, pilot.dtype)
    for i, a in enumerate(dr):
        vr = np.flatnonzero(ok_r[:, i])
        if not len(vr):
            continue
        r0, nr = rows[vr[0]] - tile.top, len(vr)
        span_r = (nr - 1) * step + size
        for j, b in enumerate(dc):
            vc = np.flatnonzero(ok_c[:, j])
            if not len(vc) or a == b == 0:
                continue
            c0, nc = cols[vc[0]] - tile.left, len(vc)
            span_c = (nc - 1) * step + size
            d = pilot[r0 : r0 + span_r, c0 : c0 + span_c] - pilot[r0 + a : r0 + a + span_r, c0 + b : c0 + b + span_c]
            d *= d
            by_row = d[0 : (nr - 1) * step + 1 : step].copy()
            for k in range(1, size):
                by_row += d[k : k + (nr - 1) * step + 1 : step]
            total = by_row[:, 0 : (nc - 1) * step + 1 : step].copy()
            for k in range(1, size):
                total += by_row[:, k : k + (nc - 1) * step + 1 : step]
            dist[i * len(dc) + j, vr[0] : vr[-1] + 1, vc[0] : vc[-1] + 1] = total
    dist = np.ascontiguousarray(dist.reshape(len(dist), n).T)
    k = max(0, min(p.matches - 1, dist.shape[1]))
    order = np.argsort(dist, axis=1, kind="stable")[:, :k]  # offsets stand in (row, column) order
    d = np.take_along_axis(dist, order, 1)
    none = ~np.isfinite(d)
    rr, cc = np.repeat(rows, len(cols))[:, None], np.tile(cols, len(rows))[:, None]
    mr = np.where(none, -1, rr + dr[order // len(dc)])
    mc = np.where(none, -1, cc + dc[order % len(dc)])
    return np.hstack([rr, mr]), np.hstack([cc, mc]), np.hstack([np.zeros((n, 1)), np.where(none, -1.0, d)])


def match_rows(pilot: np.ndarray, r0: int, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the references of one grid row: their columns, and the matches as of ``match_grid``."""
    tile = Tile(*pilot.shape)
    cols = _grid(0, tile.width, tile.width, p)
    return cols, *match_grid(pilot, np.array([r0]), cols, p, tile)


_H2 = np.array([[1.0, 1.0], [1.0, -1.0]])
HADAMARD_8 = np.kron(np.kron(_H2, _H2), _H2)


def _spectra(patches: np.ndarray, hadamard: bool) -> np.ndarray:
    """2-D transforms of patches; of the Fourier transform the half that tells the rest."""
    return HADAMARD_8.astype(patches.dtype) @ patches @ HADAMARD_8.astype(patches.dtype) if hadamard else np.fft.rfft2(patches)


def _patches(spectra: np.ndarray, size: int, hadamard: bool) -> np.ndarray:
    return HADAMARD_8 @ spectra.real @ HADAMARD_8 / 64 if hadamard else np.fft.irfft2(spectra, (size, size))


def _doubled(size: int, hadamard: bool) -> np.ndarray:
    """How many coefficients of the whole spectrum each one of the half stands for."""
    if hadamard:
        return np.ones((size, size))
    v = np.arange(size // 2 + 1)
    return np.broadcast_to(np.where((v == 0) | (2 * v == size), 1.0, 2.0), (size, len(v)))


#: References that are matched at a time, and groups that are filtered at a time (so few that they stay in the processor's cache).
REFERENCES, GROUPS = 4096, 256


def collaborative_filter(noisy: np.ndarray, pilot: np.ndarray, p: Params, wiener: bool, sigma_map: np.ndarray | None = None, psd: np.ndarray | None = None, tile: Tile | None = None) -> np.ndarray:
    """One pass: groups of similar patches are transformed, shrunk, and added back with weights; uncovered pixels stay.

    ``sigma_map`` is a column profile or an image of the array's size; with ``psd`` the noise of a coefficient is coloured by it.
    The array may be a ``tile`` of an image: then pixels nearer than ``reach`` to an edge within the image are not final.
    The transform is linear, so each patch is transformed once, not once a group; what the groups make of it is added up
    in the transformed domain and transformed back once.  Computed in single precision for float32 images."""
    tile = tile or Tile(*noisy.shape)
    size = p.patch
    if tile.height < size or tile.width < size:
        return noisy.copy()
    real = np.float32 if noisy.dtype == np.float32 else np.float64
    noisy, pilot = np.ascontiguousarray(noisy, real), np.ascontiguousarray(pilot, real)
    h, w = noisy.shape
    num, den = np.zeros((h, w), real), np.zeros((h, w), real)
    src, ref = (np.lib.stride_tricks.sliding_window_view(x, (size, size)) for x in (noisy, pilot))
    blend = tp.blend_window(size).astype(real)
    twice = _doubled(size, p.hadamard).ravel().astype(real)
    s2 = p.sigma_random**2
    colours = None if psd is None else (psd[:, : size if p.hadamard else size // 2 + 1] ** 2).ravel().astype(real)
    all_rows, cols = _grid(tile.top, h, tile.height, p), _grid(tile.left, w, tile.width, p)
    band = max(1, REFERENCES // max(1, len(cols)))
    for first in range(0, len(all_rows) if len(cols) else 0, band):
        mr, mc, _ = match_grid(pilot, all_rows[first : first + band], cols, p, tile)
        own_r, own_c = mr[:, 0] - tile.top, mc[:, 0] - tile.left
        local = np.zeros(len(mr), real) if sigma_map is None else (sigma_map[own_c] if sigma_map.ndim == 1 else sigma_map[own_r, own_c]).astype(real)
        counts = (mr >= 0).sum(1)
        flat = np.where(mr >= 0, (mr - tile.top) * w + mc - tile.left, -1)
        places = np.unique(flat[flat >= 0])
        index = np.searchsorted(places, flat)
        pr, pc = places // w, places % w
        spec = _spectra(src[pr, pc], p.hadamard).reshape(len(places), -1)
        spec_ref = _spectra(ref[pr, pc], p.hadamard).reshape(len(places), -1) if wiener else None
        added, weights = np.zeros((len(places), spec.shape[1]), np.result_type(spec.dtype, np.complex64)), np.zeros(len(places), real)
        for k in np.unique(counts):
            dft = np.fft.fft(np.eye(k)).astype(added.dtype)
            idft = dft.conj() / dft.dtype.type(k)
            alike = np.flatnonzero(counts == k)
            for at in np.split(alike, range(GROUPS, len(alike), GROUPS)):
                ix = index[at, :k]
                coeff = dft @ spec[ix]
                var = np.full((len(at), 1, spec.shape[1]), k * s2 * size * size, real)
                if colours is not None:
                    var += (k * k * size * size) * (local[at] ** 2)[:, None, None] * colours
                if wiener:
                    q = dft @ spec_ref[ix]
                    gain = q.real**2
                    gain += q.imag**2
                    var += real(1e-8)
                    gain /= gain + var
                    weight = np.minimum(1e6, 1 / ((np.einsum("nkc,nkc->nc", gain, gain) @ twice) * s2 + 1e-8)).astype(real)
                else:
                    gain = coeff.real**2
                    gain += coeff.imag**2
                    var *= real(p.threshold**2)
                    gain = (gain >= var).astype(real)
                    weight = (1.0 / (gain.sum(1) @ twice + 1)).astype(real)
                gain *= weight[:, None, None]
                coeff *= gain
                back = (idft @ coeff).reshape(-1, spec.shape[1])
                to = ix.ravel()
                order = np.argsort(to, kind="stable")
                begin = np.flatnonzero(np.diff(to[order], prepend=-1))
                added[to[order[begin]]] += np.add.reduceat(back[order], begin, axis=0)
                weights += np.bincount(to, np.repeat(weight, k), len(places)).astype(real)
        patches = _patches(added.reshape(len(places), size, -1), size, p.hadamard) * blend
        for i in range(size):
            for j in range(size):  # places differ, so nothing is added twice at once
                num[pr + i, pc + j] += patches[:, i, j]
                den[pr + i, pc + j] += weights * blend[i, j]
    good = den > 1e-6
    return np.where(good, num / np.where(good, den, 1), noisy)


def reach(p: Params) -> int:
    """How far one pass looks, in whole steps."""
    return -(-(2 * (p.window // 2) + p.patch) // p.step) * p.step


def two_passes(z: np.ndarray, p: Params, sigma_map: np.ndarray, psd: np.ndarray | None, tile: Tile | None = None, inner: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """Hard threshold, then Wiener with its result as pilot.

    Of a ``tile`` that reaches two ``reach`` beyond ``inner`` (rows and columns from, to) or to the image's edge, ``inner`` is returned."""
    first = collaborative_filter(z, z, p, False, sigma_map, psd, tile)
    if tile is None:
        return collaborative_filter(z, first, p, True, sigma_map, psd)
    r0, r1, c0, c1 = inner
    a, b = max(tile.top, r0 - reach(p)), min(tile.top + z.shape[0], r1 + reach(p))
    l, r = max(tile.left, c0 - reach(p)), min(tile.left + z.shape[1], c1 + reach(p))
    cut = np.s_[a - tile.top : b - tile.top, l - tile.left : r - tile.left]
    levels = sigma_map[cut[1]] if sigma_map.ndim == 1 else sigma_map[cut]
    out = collaborative_filter(z[cut], first[cut], p, True, levels, psd, Tile(tile.height, tile.width, a, l))
    return out[r0 - a : r1 - a, c0 - l : c1 - l]


def cuts(n: int, side: int, p: Params) -> list[tuple[int, int]]:
    """An axis in parts of about ``side``, in whole steps: (from, to)."""
    parts = max(1, round(n / side))
    at = [min(n, round(i * n / parts / p.step) * p.step) for i in range(parts)] + [n]
    return [(x, y) for x, y in zip(at, at[1:]) if y > x]


def tiles(height: int, width: int, side: int, p: Params) -> list[tuple[tuple[int, int, int, int], Tile, tuple[slice, slice]]]:
    """An image in tiles of about ``side``: (inner part, tile, and its slices of the image with the edge that two passes need)."""

    far, out = 2 * reach(p), []
    for r0, r1 in cuts(height, side, p):
        for c0, c1 in cuts(width, side, p):
            top, left = max(0, r0 - far), max(0, c0 - far)
            out.append(((r0, r1, c0, c1), Tile(height, width, top, left), np.s_[top : min(height, r1 + far), left : min(width, c1 + far)]))
    return out


def fourier_energy(a: np.ndarray, notch_width: float = 2.0) -> np.ndarray:
    """Mean magnitude by column of what is slow down the columns and fast along the rows, over its median."""
    h, w = a.shape
    far = lambda n: np.minimum(np.arange(n), n - np.arange(n))
    low = lambda n: np.exp(-0.5 * (far(n) / notch_width) ** 2)
    e = np.abs(np.fft.ifft2(np.fft.fft2(a) * low(h)[:, None] * (1 - low(w))[None]).real).mean(0)
    m = np.median(e)
    return e / m if m > 1e-10 else e


def power_iteration(a: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, float, np.ndarray]:
    v, u, s = np.full(a.shape[1], 1 / np.sqrt(a.shape[1])), np.zeros(a.shape[0]), 0.0
    for _ in range(rounds):
        u = a @ v
        if (n := np.linalg.norm(u)) < 1e-10:
            break
        u = u / n
        v = a.T @ u
        s = float(np.linalg.norm(v))
        if s < 1e-10:
            break
        v = v / s
    return u, s, v


def fourier_svd(a: np.ndarray, fft_alpha: float = 1.0, notch_width: float = 2.0) -> np.ndarray:
    """Rank-one streaks by power iteration; small details of its column vector count as streaks, gated by the Fourier energy."""
    if min(a.shape) < 10:
        return a.copy()
    a = a.astype(np.float64)
    u, s, v = power_iteration(a)
    detail = v - running_median(v, 51)
    t = 3 * robust_sigma(detail) * (1 + fft_alpha * fourier_energy(a, notch_width) if fft_alpha > 1e-6 else np.ones_like(v))
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        streak = np.where(t > 1e-10, detail / (1 + (np.abs(detail) / t) ** 6), 0.0)
    return a - s * np.outer(u, streak)


MODES = ("generic", "streak", "multiscale_streak", "fourier_svd")


@dataclass(frozen=True)
class Prepared:
    """An image ready for the two passes: scaled, without streaks, with noise levels by column; ``flat`` where there is nothing to filter."""

    z: np.ndarray
    levels: np.ndarray
    psd: np.ndarray | None
    params: Params
    lo: float
    hi: float
    flat: bool = False

    def finish(self, filtered: np.ndarray) -> np.ndarray:
        return np.full(self.z.shape, self.lo, self.z.dtype) if self.flat else (filtered * (self.hi - self.lo) + self.lo).astype(self.z.dtype)


def prepare(a: np.ndarray, mode: str = "generic", p: Params | None = None, ends: tuple[float, float] | None = None, sigma_map: np.ndarray | None = None) -> Prepared:
    """Scale to [0, 1] by the image's own ends or given ones, take noise levels (or given ones), subtract streaks by mode.  float32 stays float32."""
    p = (p or Params()).checked()
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if min(a.shape) < p.patch:
        raise ValueError("the image is smaller than a patch")
    a = a if a.dtype == np.float32 else a.astype(np.float64)
    lo, hi = (float(a.min()), float(a.max())) if ends is None else ends
    streaky = mode in ("streak", "multiscale_streak")
    psd = tp.anisotropic_psd(p.patch, p.psd_width) if streaky else None
    if hi - lo <= 1e-10:
        if ends is None:
            return Prepared(a, np.zeros(a.shape[1]), psd, p, lo, hi, True)
        lo, hi = 0.0, 1.0
    z = (a - a.dtype.type(lo)) / a.dtype.type(hi - lo)
    levels = sigma_profile(z, p.map_smoothing, p.map_scale) if sigma_map is None else np.asarray(sigma_map)
    z = z - streak_profile(z, p.streak_sigma, p.streak_iterations).astype(a.dtype) if streaky else fourier_svd(z).astype(a.dtype) if mode == "fourier_svd" else z
    return Prepared(z, levels, psd, p if p.sigma_random > 1e-6 or ends is not None else replace(p, sigma_random=noise_sigma(z)), lo, hi)


def remove_rings(a: np.ndarray, mode: str = "generic", p: Params | None = None) -> np.ndarray:
    """Two-pass filtering of one image: normalise, subtract streaks by mode, hard threshold, Wiener, denormalise."""
    r = prepare(a, mode, p)
    return r.finish(r.z if r.flat else two_passes(r.z, r.params, r.levels, r.psd))


def bin_columns(a: np.ndarray) -> np.ndarray:
    if a.shape[1] % 2:
        a = np.hstack([a, a[:, -1:]])
    return a[:, ::2] + a[:, 1::2]


def debin(binned: np.ndarray, width: int, iterations: int) -> np.ndarray:
    """Rows of ``width`` whose bins are the given rows: residuals projected back by Catmull-Rom interpolation, again and again."""
    n = (width + 1) // 2
    binned = np.asarray(binned, float)
    out = np.zeros((len(binned), width))
    if n < 2:
        return out
    centre = 1 + 2 * np.arange(n)
    norm = np.where(centre < width, 0.5, 0.0)  # the last bin of an odd width has no centre and gives nothing
    knots = centre + 0.5
    x = np.clip(np.arange(1, width + 1, dtype=float), knots[0], knots[-1])
    i = np.minimum(np.searchsorted(knots, x, side="right") - 1, n - 2).clip(0)
    t = (x - knots[i]) / 2
    parts = (-t + 2 * t**2 - t**3, 2 - 5 * t**2 + 3 * t**3, t + 4 * t**2 - 3 * t**3, -(t**2) + t**3)
    at = [np.clip(i + off, 0, n - 1) for off in (-1, 0, 1, 2)]
    for _ in range(max(1, iterations)):
        rest = (binned - bin_columns(out)) * norm
        for place, part in zip(at, parts, strict=True):
            out += rest[:, place] * (0.5 * part)
    return out


def debin_matrix(width: int, iterations: int) -> np.ndarray:
    """Matrix D with debinned row = binned row @ D."""
    return debin(np.eye((width + 1) // 2), width, iterations)


def column_constant(diff: np.ndarray, sigma: float) -> np.ndarray:
    """Profile added to every row: column medians less their wide running median, without walls."""
    p = upper_median(diff, 0)
    p = p - running_median(p, 201)
    on = np.abs(p) > 0.5 * sigma
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(int), [0]))))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a > 20 and np.abs(p[a:b]).max() > 8 * sigma:
            p[a:b] = 0
    return p


def level_image(a: np.ndarray, s: int) -> np.ndarray:
    """The image binned ``s`` times."""
    for _ in range(s):
        a = bin_columns(a)
    return a


def multiscale_sigma(a: np.ndarray, p: Params) -> float:
    return p.sigma_random if p.sigma_random > 1e-6 else noise_sigma_robust(a)


def level_prepare(a: np.ndarray, s: int, p: Params, add: np.ndarray) -> Prepared | None:
    """Scale ``s`` of an image, with the profile that the coarser scale gave, ready for the two passes; None if it is smaller than a patch."""
    work = level_image(a, s) + add
    if min(work.shape) < p.patch:
        return None
    z = work / 2**s
    local = noise_sigma_robust(z)
    return prepare(z, "streak", replace(p, threshold=p.threshold * p.filter_strength, window=level_window(p, s), sigma_random=local if local > 0.001 else p.sigma_random))


def level_window(p: Params, s: int) -> int:
    return max(8, p.window >> s)


def level_profile(a: np.ndarray, s: int, p: Params, add: np.ndarray, done: np.ndarray | None, sigma: float) -> np.ndarray:
    """Profile that scale ``s`` gives to the next finer one, from its filtered image (None: it gives on what it got)."""
    level = level_image(a, s)
    if done is None:
        profile = np.broadcast_to(add, level.shape[1:])
    else:
        fine = ((a - upper_median(a, 0)) ** 2).mean(0)
        res = done * 2**s - level
        med = upper_median(res, 0)
        var = ((res - med) ** 2).mean(0)
        width = 1 << s
        worst = np.array([fine[c * width : (c + 1) * width].max(initial=0.0) for c in range(res.shape[1])])
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(med**2 + var > 0, med**2 / (med**2 + var), 0.0)
        v = med * np.where(worst > 2 * sigma**2, 0.0, score) ** 8
        profile = v - running_median(v, 201)
    return debin((profile / 2)[None], level_image(a[:1], s - 1).shape[1], p.debin_iterations)[0]


def multiscale_finish(a: np.ndarray, add: np.ndarray, done: np.ndarray | None, sigma: float) -> np.ndarray:
    return a + column_constant((a + add if done is None else done) - a, sigma)


def multiscale(a: np.ndarray, p: Params | None = None, scales: int | None = None) -> np.ndarray:
    """Coarse-to-fine streak removal; the result differs from the input by one constant for each column."""
    p = (p or Params(sigma_random=0.0, threshold=3.5, debin_iterations=10)).checked()
    kind = np.float32 if a.dtype == np.float32 else np.float64
    a = a.astype(np.float64)
    k = tp.number_of_scales(a.shape[1]) if scales is None else scales
    if k == 0:
        return remove_rings(a, "streak", p).astype(kind)
    add, done, sigma = np.zeros(level_image(a[:1], k).shape[1]), None, multiscale_sigma(a, p)
    for s in range(k, -1, -1):
        r = level_prepare(a, s, p, add)
        done = None if r is None else r.finish(r.z if r.flat else two_passes(r.z, r.params, r.levels, r.psd))
        if s:
            add = level_profile(a, s, p, add, done, sigma)
    return multiscale_finish(a, add, done, sigma).astype(kind)


def residual_kernel(width: int = 64, iterations: int = 10) -> np.ndarray:
    """Impulse response of (identity - debin of bin), mean of both phases, centred."""
    d = bin_columns(np.eye(width)) @ debin_matrix(width, iterations)
    m = np.eye(width) - d / 2
    c = width // 2
    return (m[c] + np.roll(m[c + 1], -1)) / 2
