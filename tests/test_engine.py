import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from streakline.functions import taps as tp
from streakline.kernels import images as k
from streakline.operators import neighbourhood as nb
from streakline.operators import pointwise as pw
from streakline.operators import stats as st
from streakline.plans import denoise as dn
from streakline.sources import synthetic as sy
from streakline.sources import tiff
from streakline.sources import views as vw
from streakline.streaming import denoise as stream


def pixels(spark, a):
    return vw.from_slices(sy.to_slices(spark, a))


def image(df):
    r = df.collect()
    out = np.full((max(x["row"] for x in r) + 1, max(x["col"] for x in r) + 1), np.nan)
    for x in r:
        out[x["row"], x["col"]] = x["value"]
    return out


@pytest.fixture(scope="module")
def a():
    return np.random.default_rng(1).random((20, 24))


def test_forms_round_trip(spark, a):
    p = pixels(spark, a)
    assert np.array_equal(image(p), a) and np.array_equal(image(vw.from_rows(vw.to_rows(p))), a) and np.array_equal(image(vw.from_columns(vw.to_columns(p))), a)
    s = vw.to_slices(p).first()
    assert (s.height, s.width) == (20, 24) and np.array_equal(np.reshape(s["values"], (20, 24)), a)


def test_sql_and_kernel_agree(spark, a):
    p = pixels(spark, a)
    assert np.allclose(image(nb.gaussian_2d(p, 2.0, 1.0)), k.blur(a, 2.0, 1.0))
    prof = {r.col: r.value for r in nb.streak_profile(p, 3.0, 2).collect()}
    assert np.allclose([prof[c] for c in range(24)], k.streak_profile(a, 3.0, 2))
    m = {(r.ref_row, r.ref_col, r["rank"]): (r.row, r.col, r.distance) for r in nb.match_patches(p, matches=4).collect()}
    q = {(r.ref_row, r.ref_col, r["rank"]): (r.row, r.col, r.distance) for r in dn.matches(sy.to_slices(spark, a), k.Params(matches=4)).collect()}
    assert m.keys() == q.keys() and all(m[x][:2] == q[x][:2] and abs(m[x][2] - q[x][2]) < 1e-9 for x in m)
    v = {r.col: r.value for r in nb.power_iteration(p, 6).collect()}
    assert np.allclose([v[c] for c in range(24)], k.power_iteration(a, 6)[2])
    assert np.allclose(image(nb.bin_horizontal(p)), k.bin_columns(a))
    assert np.allclose(image(nb.integral_image(p).withColumn("value", F.col("total"))), a.cumsum(0).cumsum(1))


def test_medians_and_stats(spark):
    p = pixels(spark, np.array([[1.0, 5], [2, 5], [3, 5], [4, 5]]))
    assert {r.col: r.value for r in st.column_median(p).collect()} == {0: 2.5, 1: 5.0}
    assert {r.col: r.value for r in st.column_upper_median(p).collect()} == {0: 3.0, 1: 5.0}
    assert [r.p for r in st.empirical_cdf(pixels(spark, np.arange(9.0).reshape(3, 3))).orderBy("i").collect()] == np.linspace(0, 1, 9).tolist()
    flat = pixels(spark, np.full((3, 3), 2.0))
    assert st.histogram(flat).first().height == 1.0 and image(pw.minmax_slice(flat)).max() == 0 and image(pw.denormalize(pw.minmax_slice(flat))).min() == 2.0
    odd = spark.createDataFrame([(0, 0, 0, float("nan")), (0, 0, 1, 1.0), (0, 0, 2, None), (0, 0, 3, float("inf"))], "slice_id int, row int, col int, value double")
    r = st.image_stats(odd).first()
    assert (r.n, r.mean_value, r.std_value) == (1, 1.0, 0.0)


def test_matrix_form_of_debin(spark, a):
    binned = pixels(spark, k.bin_columns(a))
    assert np.allclose(image(nb.apply_column_matrix(binned, k.debin_matrix(24, 5))), k.bin_columns(a) @ k.debin_matrix(24, 5))


def test_natural_order(spark):
    df = spark.createDataFrame([(x,) for x in ("img_10.tif", "img_2.tif", "IMG_1.tif", "a", "10b", "9b", "img")], "n string")
    assert [r.n for r in df.orderBy(tp.natural_key(F.col("n"))).collect()] == ["9b", "10b", "a", "img", "IMG_1.tif", "img_2.tif", "img_10.tif"]


def test_tiff_round_trip(spark, tmp_path):
    stack = np.random.default_rng(2).random((12, 5, 7)).astype(np.float32)
    assert np.array_equal(tiff.decode(tiff.encode(stack)), stack)
    tiff.save(sy.to_slices(spark, stack), f"{tmp_path}/out", "tiff")
    assert len(os.listdir(f"{tmp_path}/out")) == 12
    back = tiff.load(spark, f"{tmp_path}/out").orderBy("slice_id").collect()
    assert [r.slice_id for r in back] == list(range(12))
    assert np.array_equal(np.array([r["values"] for r in back]).reshape(stack.shape), stack)
    with pytest.raises(ValueError):
        tiff.decode(b"not a tiff at all")


def test_phantom_and_sinogram(spark):
    p = image(sy.shepp_logan(spark, 64))
    assert p.min() == 0 and p.max() == 1
    s = image(sy.sinogram(sy.to_slices(spark, p), 30.0))
    assert s.shape == (12, 91) and abs(s.min() - sy.FLOOR) < 1e-12 and abs(s.max() - 1 - sy.FLOOR) < 1e-12
    whole = sy.to_diagonal(p)
    assert abs(whole.sum() - p.sum()) < 1e-9 and np.allclose(sy.rotate(whole, 0.0), whole) and abs(sy.rotate(whole, 37.0).sum() / p.sum() - 1) < 0.01
    g = image(sy.detector_gain(pixels(spark, p), error=0.01))
    assert g.shape == p.shape and np.isfinite(g).all()
    assert sy.synthetic_noise((32, 16)).shape == (32, 16)


def test_stack_modes_and_progress(spark):
    stack = np.random.default_rng(42).normal(0.5, 0.1, (4, 32, 32))
    s, seen = sy.to_slices(spark, stack), []
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    done = dn.process_volume(s, "generic", progress=lambda i, n: seen.append((i, n)), batch=3).orderBy("slice_id").collect()
    assert seen == [(3, 4), (4, 4)] and len(done) == 4
    assert np.allclose(done[1]["values"], k.remove_rings(stack[1]).ravel())
    shared = dn.remove_streaks(s, "streak", normalize="stack").collect()
    assert len(shared) == 4 and all(np.isfinite(r["values"]).all() for r in shared)
    for kw in ({"mode": "streak"}, {"mode": "fourier_svd", "normalize": "stack"}, {"multiscale": True}, {"mode": "streak", "sigma_map": np.full(32, 0.1)}, {"mode": "streak", "sigma_map": np.full((32, 32), 0.1)}):
        whole, tiled = ({r.slice_id: r["values"] for r in dn.remove_streaks(s, side=side, **kw).collect()} for side in (None, 12))
        assert whole.keys() == tiled.keys() and all(np.allclose(whole[i], tiled[i], atol=1e-9) for i in whole)
    wide = sy.to_slices(spark, np.random.default_rng(1).random((2, 24, 90)))
    whole, tiled = (np.array([r["values"] for r in dn.remove_streaks(wide, multiscale=True, params=dn.parameters("multiscale"), side=side).orderBy("slice_id").collect()]) for side in (None, 30))
    assert np.allclose(whole, tiled, atol=1e-9)
    maps = s.withColumn("levels", F.array_repeat(F.lit(0.05) * (F.col("slice_id") + 1), 32))
    by_slice = {r.slice_id: r["values"] for r in dn.remove_streaks(maps, "streak", sigma_map="levels").collect()}
    assert np.allclose(by_slice[2], dn.remove_streaks(s.filter("slice_id = 2"), "streak", sigma_map=[0.15] * 32).first()["values"])
    with pytest.raises(ValueError):
        dn.remove_streaks(s, "unknown")
    assert dn.noise_sigma(s).count() == 4


def test_stream_equals_batch(spark, tmp_path):
    s = sy.to_slices(spark, np.random.default_rng(3).random((3, 24, 24)))
    s.repartition(3).write.parquet(f"{tmp_path}/in")
    q = stream.write_stream(stream.denoise_stream(stream.slice_stream(spark, f"{tmp_path}/in", 1)), f"{tmp_path}/out", f"{tmp_path}/check")
    assert q.awaitTermination(120) is not False
    want = {r.slice_id: r["values"] for r in dn.remove_streaks(s, "streak").collect()}
    got = {r.slice_id: r["values"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)


def test_hdf5_is_optional(spark):
    pytest.importorskip("pyspark")
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            tiff.load(spark, "x.h5", "d")


def test_entry_points():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and {"flagship_destreak_stats", "match_patches_topk", "remove_streaks_multiscale"} <= set(q)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["image_stats", "histogram_64", "mad_sigma", "streak_profile_1", "overlap_add", "natural_sort"])
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    df = e.queries()[name](spark, d)
    con = duckdb.connect()
    for t in ("embeddings", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    cur = con.execute(e.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    cols = sorted(df.columns)
    assert cols == sorted(names)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())


def test_matches_by_bands_equal_whole_image(spark):
    """Bands of an image, with gaps in the numbers of its rows, give the matches of the whole image; no row of the plan holds an image."""
    import numpy as np

    from streakline.kernels import images as kn
    from streakline.plans import denoise as dn

    a, p = np.random.default_rng(3).random((75, 21)), kn.Params()
    rows = spark.createDataFrame([(0, 7 * i - 100, x.tolist()) for i, x in enumerate(a)], "slice_id int, row int, values array<double>")
    got = {tuple(r)[1:6]: r["distance"] for r in dn.matches_of_rows(rows, p, 16).collect()}
    want = {}
    for r0 in range(0, 75 - p.patch + 1, p.step):
        refs, mr, mc, d = kn.match_rows(a, r0, p)
        want |= {(r0, int(refs[i]), j + 1, int(mr[i, j]), int(mc[i, j])): d[i, j] for i, j in zip(*np.nonzero(mr >= 0), strict=True)}
    assert got == want


def test_strips_equal_whole_images(spark):
    """Strips of two images, whose numbers of rows have gaps, give what each whole image gives on the stack's ends."""
    import numpy as np

    from streakline.kernels import images as kn
    from streakline.plans import denoise as dn

    stack, p = np.random.default_rng(4).random((2, 70, 150)) + np.sin(np.arange(150)), kn.Params()
    rows = spark.createDataFrame([(s, 3 * i - 9, x.tolist()) for s, a in enumerate(stack) for i, x in enumerate(a)], "slice_id int, row int, values array<double>")
    got = np.zeros_like(stack)
    for r in dn.remove_streaks_strips(rows, p, side=48).collect():
        got[r["slice_id"], r["row"], r["col"]] = r["value"]
    for s, a in enumerate(stack):
        r = kn.prepare(a, "streak", p, (stack.min(), stack.max()))
        assert np.allclose(got[s], r.finish(kn.two_passes(r.z, r.params, r.levels, r.psd)), rtol=0, atol=1e-9)
