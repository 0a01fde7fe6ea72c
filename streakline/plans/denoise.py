"""Composite operators on stacks in slice form: each slice is one row and is filtered where it lies (no shuffle), or in tiles."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import taps as tp
from ..kernels import images as k
from ..sources import views as vw

SLICES = "slice_id int, height int, width int, values array<{}>"
#: Parts of images on their way: tile number (-1: the image itself, waiting), places, numbers, pixels, noise levels or profile.
TILES = "slice_id int, tile int, place array<int>, numbers array<double>, values array<{0}>, levels array<double>"


def _kind(slices: DataFrame) -> str:
    """Stacks of single precision stay so; all others are computed in double precision."""
    return "float" if dict(slices.dtypes)["values"] == "array<float>" else "double"


def _slices(slices: DataFrame, extra: list[str]) -> DataFrame:
    return slices.select(*[F.col(c).cast("int").alias(c) for c in ("slice_id", "height", "width")], F.col("values").cast(f"array<{_kind(slices)}>").alias("values"), *extra)


def _numpy(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def _lists(values: list[np.ndarray], kind: np.dtype) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(np.size, values)]), pa.int32()), pa.array(np.concatenate([np.ravel(v).astype(kind, copy=False) for v in values])))


def map_slices(slices: DataFrame, fn: Callable[[np.ndarray], np.ndarray], extra: list[str] | None = None) -> DataFrame:
    """A function of one image on every slice, by Arrow batches of few rows; works on batch and streaming frames alike."""
    extra, kind = extra or [], _kind(slices)
    real = np.float32 if kind == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one image at a time: its arrays are all that is held
                h, w = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                args = [batch.column(4 + j)[i].as_py() for j in range(len(extra))]
                out = np.asarray(fn(_numpy(batch.column(3), i).reshape(h, w), *args), real)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([out.shape[0]], pa.int32()), pa.array([out.shape[1]], pa.int32()), _lists([out], real)], names=["slice_id", "height", "width", "values"])

    return _slices(slices, extra).mapInArrow(run, SLICES.format(kind))


def _rows(slice_id: pa.Array, tile: int, place: tuple, numbers: list[float], values: np.ndarray, levels: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [slice_id, pa.array([tile], pa.int32()), _lists([np.array(place)], np.int32), _lists([np.array(numbers, float)], np.float64), _lists([values], values.dtype), _lists([levels], np.float64)], names=["slice_id", "tile", "place", "numbers", "values", "levels"]
    )


def _cut(slice_id: pa.Array, r: k.Prepared, side: int) -> Iterator[pa.RecordBatch]:
    """Rows of the tiles of a prepared image; a flat one is a single tile that needs no filter (its number of rows to keep is 0)."""
    h, w = r.z.shape
    numbers = [r.lo, r.hi, float(r.flat), r.params.sigma_random, r.params.threshold, r.params.window]
    if r.flat:
        yield _rows(slice_id, 0, (h, w, 0, 0, 0, h, 0, w, h, w), numbers, r.z, r.levels)
        return
    for n, (inner, tile, cut) in enumerate(k.tiles(h, w, side, r.params)):
        z = r.z[cut]
        levels = r.levels[cut[1]] if r.levels.ndim == 1 else r.levels[cut]
        yield _rows(slice_id, n, (h, w, tile.top, tile.left, *inner, *z.shape), numbers, z, levels)


def _filter_tiles(tiles: DataFrame, p: k.Params, psd: np.ndarray | None) -> DataFrame:
    """Both passes on every tile, dealt out evenly over the tasks; waiting images go through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                number, numbers = row.column(1)[0].as_py(), _numpy(row.column(3), 0)
                if number < 0 or numbers[2]:
                    yield row
                    continue
                h, w, top, left, r0, r1, c0, c1, th, tw = map(int, _numpy(row.column(2), 0))
                z, levels = _numpy(row.column(4), 0).reshape(th, tw), _numpy(row.column(5), 0)
                levels = levels.reshape(th, tw) if levels.size == th * tw and th > 1 else levels
                at = replace(p, sigma_random=float(numbers[3]), threshold=float(numbers[4]), window=int(numbers[5]))
                out = k.two_passes(z, at, levels, psd, k.Tile(h, w, top, left), (r0, r1, c0, c1))
                yield _rows(row.column(0), number, (h, w, top, left, r0, r1, c0, c1, *out.shape), list(numbers), out.astype(z.dtype), np.empty(0))

    return tiles.repartition(vw.tasks(tiles)).mapInArrow(run, tiles.schema)


def _gather(tiles: DataFrame, fn: Callable[[pa.Array, np.ndarray | None, tuple | None], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn(slice_id, filtered image or None, (waiting image, its numbers, its profile) or None)`` once all tiles of a slice are there."""

    def image(parts: pa.StructArray) -> tuple[np.ndarray | None, tuple | None]:
        out, waiting = None, None
        names = {f.name: parts.field(f.name) for f in parts.type}
        for i in range(len(parts)):
            place, numbers, values = (_numpy(names[x], i) for x in ("place", "numbers", "values"))
            h, w, top, left, r0, r1, c0, c1 = map(int, place[:8])
            if names["tile"][i].as_py() < 0:
                waiting = values.reshape(h, w), numbers, _numpy(names["levels"], i)
                continue
            if out is None:
                out = np.empty((h, w), values.dtype)
            lo, hi = numbers[:2]
            out[r0:r1, c0:c1] = lo if numbers[2] else values.reshape(r1 - r0, c1 - c0) * (hi - lo) + lo
        return out, waiting

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from fn(batch.column(0).slice(i, 1), *image(batch.column(1)[i].values))

    whole = tiles.groupBy("slice_id").agg(F.collect_list(F.struct("tile", "place", "numbers", "values", "levels")).alias("parts"))
    return whole.mapInArrow(run, schema)


def _image_row(slice_id: pa.Array, out: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([slice_id, pa.array([out.shape[0]], pa.int32()), pa.array([out.shape[1]], pa.int32()), _lists([out], out.dtype)], names=["slice_id", "height", "width", "values"])


def _tiled(slices: DataFrame, prepare: Callable[..., k.Prepared], extra: list[str], p: k.Params, psd: np.ndarray | None, side: int) -> DataFrame:
    """Prepared images (one at a time) in tiles, and back: each time dealt out evenly, since few large rows make few tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, w = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                args = [batch.column(4 + j)[i].as_py() for j in range(len(extra))]
                yield from _cut(batch.column(0).slice(i, 1), prepare(_numpy(batch.column(3), i).reshape(h, w), *args), side)

    kind = _kind(slices)
    tiles = _slices(slices, extra).repartition(vw.tasks(slices)).mapInArrow(cut, TILES.format(kind))
    return _gather(_filter_tiles(tiles, p, psd), lambda i, out, _: iter([_image_row(i, out)]), SLICES.format(kind))


def _multiscale_tiled(slices: DataFrame, p: k.Params, side: int, scales: int | None) -> DataFrame:
    """Scale by scale, the coarsest first; between scales an image waits with the profile it has so far.  Images of fewer scales join in later."""
    kind = _kind(slices)
    real = np.float32 if kind == "float" else np.float64
    top = 3 if scales is None else scales
    psd = tp.anisotropic_psd(p.patch, p.psd_width)

    def depth(a: np.ndarray) -> int:
        return tp.number_of_scales(a.shape[1]) if scales is None else scales

    def send(slice_id: pa.Array, a: np.ndarray, add: np.ndarray, s: int, sigma: float | None) -> Iterator[pa.RecordBatch]:
        """An image that waits with its noise level, and the tiles of its scale ``s``."""
        sigma = k.multiscale_sigma(a, p) if sigma is None else sigma
        if s == depth(a):
            add = np.zeros(k.level_image(a[:1], s).shape[1])
        yield _rows(slice_id, -1, (*a.shape, 0, 0, 0, 0, 0, 0), [sigma] * 6, a, add)
        if s <= depth(a):
            r = k.prepare(a, "streak", p) if depth(a) == 0 else k.level_prepare(a, s, p, add)
            if r is not None:
                yield from _cut(slice_id, r, side)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, w = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                yield from send(batch.column(0).slice(i, 1), _numpy(batch.column(3), i).reshape(h, w).astype(np.float64), np.empty(0), top, None)

    def nearer(s: int):
        def step(slice_id: pa.Array, done: np.ndarray | None, waiting: tuple) -> Iterator[pa.RecordBatch]:
            a, numbers, add = waiting
            sigma = float(numbers[0])
            if s > depth(a):
                yield from send(slice_id, a, add, s - 1, sigma)
            elif s:
                yield from send(slice_id, a, k.level_profile(a, s, p, add, done, sigma), s - 1, sigma)
            else:
                yield _image_row(slice_id, (done if depth(a) == 0 else k.multiscale_finish(a, add, done, sigma)).astype(real))

        return step

    state = _slices(slices, []).mapInArrow(first, TILES.format("double"))
    for s in range(top, -1, -1):
        state = _gather(_filter_tiles(state, p, psd), nearer(s), TILES.format("double") if s else SLICES.format(kind))
    return state


def remove_streaks(slices: DataFrame, mode: str = "generic", params: k.Params | None = None, multiscale: bool = False, normalize: str = "slice", sigma_map: list | np.ndarray | str | None = None, side: int | None = None) -> DataFrame:
    """Ring and streak removal of a stack.

    ``normalize='slice'`` filters each image on its own scale; ``'stack'`` shares the ends of all slices and passes the noise
    level straight through; the ends are one aggregate row.  ``sigma_map`` is a profile or an image for all slices, or the name of a
    column of ``slices`` with one for each.  With ``side`` None each slice is filtered where it lies, without a shuffle, which suits
    stacks of more slices than tasks; else images are cut into tiles of about that side, which all tasks share."""
    p = (params or k.Params()).checked()
    if mode not in k.MODES or normalize not in ("slice", "stack"):
        raise ValueError("unknown mode or normalisation")
    if multiscale:
        return map_slices(slices, lambda a: k.multiscale(a, p)) if side is None else _multiscale_tiled(slices, p, side, None)
    by_slice = isinstance(sigma_map, str)
    extra = ["_lo", "_hi"] * (normalize == "stack") + [sigma_map] * by_slice
    if normalize == "stack":
        ends = slices.agg(F.min(F.array_min("values")).cast("double").alias("_lo"), F.max(F.array_max("values")).cast("double").alias("_hi"))
        slices = slices.join(F.broadcast(ends))  # one row
    shared = None if sigma_map is None or by_slice else np.asarray(sigma_map, float)

    def prepare(a: np.ndarray, *args) -> k.Prepared:
        levels = np.asarray(args[-1], float) if by_slice else shared
        if levels is not None and levels.ndim == 1 and levels.size == a.size and a.shape[0] > 1:
            levels = levels.reshape(a.shape)
        return k.prepare(a, mode, p, tuple(args[:2]) if normalize == "stack" else None, levels)

    def whole(a: np.ndarray, *args) -> np.ndarray:
        r = prepare(a, *args)
        return r.finish(r.z if r.flat else k.two_passes(r.z, r.params, r.levels, r.psd))

    if side is None:
        return map_slices(slices, whole, extra)
    return _tiled(slices, prepare, extra, p, tp.anisotropic_psd(p.patch, p.psd_width) if mode in ("streak", "multiscale_streak") else None, side)


def remove_streaks_strips(rows: DataFrame, params: k.Params | None = None, side: int = 512) -> DataFrame:
    """Pixels of ``remove_streaks`` (mode streak, normalize stack) of images in row form, in double precision; no image is ever one row.

    Images are cut into strips of columns of full height, with the columns around them that both passes need.  A strip's column medians
    come first; a slice's profile and noise levels are made of those of its strips, and go back to the strips as a row before the others."""
    p = (params or k.Params()).checked()
    psd, far = tp.anisotropic_psd(p.patch, p.psd_width), 2 * k.reach(p)
    piece = "slice_id int, strip int, kind int, row int, width int, values array<double>"
    names = ["slice_id", "strip", "kind", "row", "width", "values"]

    def span(width: int, strip: int) -> tuple[int, int, int, int]:
        """From column, to column, and the same with the edge."""
        c0, c1 = k.cuts(width, side, p)[strip]
        return c0, c1, max(0, c0 - far), min(width, c1 + far)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values, n = _numpy(batch.column(2), i), len(k.cuts(len(batch.column(2)[i]), side, p))
                parts = [values[slice(*span(len(values), s)[2:])] for s in range(n)]
                same = [np.full(n, x, np.int32) for x in (batch.column(0)[i].as_py(), 1, batch.column(1)[i].as_py(), len(values))]
                yield pa.RecordBatch.from_arrays([pa.array(same[0]), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, same[1:]), _lists(parts, np.float64)], names=names)

    def scaled(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, int, float, float]:
        """A strip, the image's width, and the ends."""
        lo, hi = (parts[0].column(i)[0].as_py() for i in (6, 7))
        lo, hi = (lo, hi) if hi - lo > 1e-10 else (0.0, 1.0)
        a = np.concatenate([x.column(5).flatten().to_numpy(zero_copy_only=False) for x in parts]).reshape(sum(x.num_rows for x in parts), -1)
        width = parts[0].column(4)[0].as_py()
        if min(len(a), width) < p.patch:
            raise ValueError("the image is smaller than a patch")
        return (a - lo) / (hi - lo), width, lo, hi

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (slice_id, strip), parts in streamed(batches, 2):
            z, width, _, _ = scaled(parts)
            c0, c1, left, _ = span(width, strip)
            found = [k.residual_medians(z, s, strip=(c0, c1, left, width)) for s in (5.0, p.streak_sigma)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (slice_id, strip)] + [_lists([x], np.float64) for x in found], names=["slice_id", "strip", "slow", "fast"])

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts = batch.column(1)[i].values
                slow, fast = (parts.field(x).flatten().to_numpy(zero_copy_only=False) for x in ("slow", "fast"))
                both, width = (k.profile_of(fast, p.streak_iterations), k.levels_of(slow, p.map_smoothing, p.map_scale)), len(slow)
                for s in range(len(parts)):
                    at = slice(*span(width, s)[2:])
                    row = [pa.array([x], pa.int32()) for x in (batch.column(0)[i].as_py(), s, 0, 0, width)]
                    yield pa.RecordBatch.from_arrays([*row, _lists([np.concatenate([x[at] for x in both])], np.float64)], names=names)

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (slice_id, strip), parts in streamed(batches, 2):
            profile, levels = parts[0].column(5)[0].values.to_numpy(zero_copy_only=False).reshape(2, -1)
            z, width, lo, hi = scaled([parts[0].slice(1), *parts[1:]] if parts[0].num_rows > 1 else parts[1:])
            z -= profile
            c0, c1, left, _ = span(width, strip)
            for r0, r1 in k.cuts(len(z), side, p):
                top = max(0, r0 - far)
                out = k.two_passes(z[top : r1 + far], p, levels, psd, k.Tile(len(z), width, top, left), (r0, r1, c0, c1)) * (hi - lo) + lo
                n = r1 - r0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (c1 - c0)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, slice_id, np.int32)), pa.array(np.arange(r0, r1, dtype=np.int32)), pa.array(np.full(n, c0, np.int32)), lists], names=["slice_id", "row", "first", "values"])

    rows = rows.select(*[F.col(x).cast("int").alias(x) for x in ("slice_id", "row")], F.col("values").cast("array<double>").alias("values"))
    ends = F.broadcast(rows.agg(F.min(F.array_min("values")).alias("_lo"), F.max(F.array_max("values")).alias("_hi")))  # one row
    pieces, keys = rows.mapInArrow(cut, piece), ["slice_id", "strip"]

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(ends).repartition(vw.tasks(df), *keys).sortWithinPartitions(*keys, "kind", "row")  # a join above would drop the order

    found = dealt(pieces).mapInArrow(medians, "slice_id int, strip int, slow array<double>, fast array<double>")
    whole = found.groupBy("slice_id").agg(F.array_sort(F.collect_list(F.struct("strip", "slow", "fast"))).alias("parts"))
    out = dealt(pieces.unionByName(whole.mapInArrow(profiles, piece))).mapInArrow(passes, "slice_id int, row int, first int, values array<double>")
    return out.select("slice_id", "row", "first", F.posexplode("values").alias("at", "value")).select("slice_id", "row", (F.col("first") + F.col("at")).alias("col"), "value")


def filter_pass(slices: DataFrame, wiener: bool, params: k.Params | None = None, coloured: bool = True) -> DataFrame:
    """One pass alone; the pilot of a Wiener pass is the hard-thresholded image."""
    p = (params or k.Params()).checked()
    psd = tp.anisotropic_psd(p.patch, p.psd_width) if coloured else None

    def run(a: np.ndarray) -> np.ndarray:
        levels = k.sigma_profile(a, p.map_smoothing, p.map_scale)
        first = k.collaborative_filter(a, a, p, False, levels, psd)
        return k.collaborative_filter(a, first, p, True, levels, psd) if wiener else first

    return map_slices(slices, run)


def fourier_svd(slices: DataFrame, fft_alpha: float = 1.0, notch_width: float = 2.0) -> DataFrame:
    return map_slices(slices, lambda a: k.fourier_svd(a, fft_alpha, notch_width))


def noise_sigma(slices: DataFrame, robust: bool = False) -> DataFrame:
    """(slice_id, sigma) by either estimator."""
    slices = slices.withColumn("values", F.col("values").cast("array<double>"))
    found = map_slices(slices, lambda a: np.array([[k.noise_sigma_robust(a) if robust else k.noise_sigma(a)]]))
    return found.select("slice_id", F.col("values")[0].alias("sigma"))


def streamed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Rows that lie together by their first ``keys`` columns, one group at a time, whatever batches they come in."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], 1)
        begins = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for x, y in zip(begins, begins[1:]):
            key = tuple(values[x].tolist())
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(batch.slice(x, y - x))
    if held:
        yield now, held


def matches_of_rows(rows: DataFrame, params: k.Params | None = None, band: int = 512) -> DataFrame:
    """``matches`` of images in row form, in bands of about ``band`` rows with the rows around them that their references look at: no image is ever one row."""
    p = (params or k.Params()).checked()
    band, half = -(-band // p.step) * p.step, p.window // 2
    names = ["ref_row", "ref_col", "rank", "row", "col"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (slice_id, number), parts in streamed(batches, 2):
            top, height = parts[0].column(2)[0].as_py(), parts[0].column(3)[0].as_py()
            a = np.concatenate([x.column(4).flatten().to_numpy(zero_copy_only=False) for x in parts]).reshape(sum(x.num_rows for x in parts), -1)
            tile = k.Tile(height, a.shape[1], top, 0)
            cols = k._grid(0, tile.width, tile.width, p)
            refs = np.arange(number * band, min((number + 1) * band, height - p.patch + 1), p.step)
            some = max(1, k.REFERENCES // max(1, len(cols)))
            for first in range(0, len(refs) if len(cols) else 0, some):
                mr, mc, d = k.match_grid(a, refs[first : first + some], cols, p, tile)
                i, j = np.nonzero(mr >= 0)
                found = [mr[i, 0], mc[i, 0], j + 1, mr[i, j], mc[i, j]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), slice_id, np.int32)), *[pa.array(x.astype(np.int32)) for x in found], pa.array(d[i, j].astype(np.float64))], names=["slice_id", *names, "distance"])

    placed = vw.numbered(rows)
    first, last = (F.floor((F.col("place") + x) / band).cast("int") for x in (-half - p.patch + 1, half))
    dealt = placed.select(F.col("slice_id").cast("int").alias("slice_id"), F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("band"), "place", "height", F.col("values").cast("array<double>").alias("values"))
    dealt = dealt.repartition(vw.tasks(rows), "slice_id", "band").sortWithinPartitions("slice_id", "band", "place")
    return dealt.mapInArrow(run, "slice_id int, " + ", ".join(f"{x} int" for x in names) + ", distance double")


def matches(slices: DataFrame, params: k.Params | None = None) -> DataFrame:
    """Match table of every reference on the grid: (slice_id, ref_row, ref_col, rank, row, col, distance)."""
    return matches_of_rows(vw.slices_to_rows(slices), params)


def process_volume(slices: DataFrame, mode: str, params: k.Params | None = None, progress: Callable[[int, int], None] | None = None, batch: int = 32, tag: str = "streakline") -> DataFrame:
    """Batch job over a volume by mode; with ``progress`` slices are run in batches and reported (the job tag allows to cancel)."""
    work = (lambda d: fourier_svd(d)) if mode == "fourier_svd" else (lambda d: remove_streaks(d, "streak", params, multiscale=True)) if mode == "multiscale_streak" else (lambda d: remove_streaks(d, mode, params))
    if progress is None:
        return work(slices)
    spark = slices.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{base.rstrip('/')}/volume-{uuid.uuid4().hex}"
    ids = sorted(r[0] for r in slices.select("slice_id").distinct().toLocalIterator())  # ids of slices only
    spark.addTag(tag)
    try:
        for a in range(0, len(ids), batch):
            work(slices.filter(F.col("slice_id").isin(ids[a : a + batch]))).write.mode("append").parquet(path)
            progress(min(a + batch, len(ids)), len(ids))
        return spark.read.schema(work(slices).schema).parquet(path) if ids else work(slices)
    finally:
        spark.removeTag(tag)


def parameters(preset: str = "api", **changes) -> k.Params:
    """Presets of the three published sets of defaults: api, core, multiscale."""
    base = {"api": k.Params(), "core": k.Params(sigma_random=0.0), "multiscale": k.Params(sigma_random=0.0, threshold=3.5, debin_iterations=10), "viewer": k.Params(sigma_random=0.0, matches=32, threshold=3.5, debin_iterations=10)}[preset]
    return replace(base, **changes).checked()
