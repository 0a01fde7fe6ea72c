import numpy as np
import pytest

from streakline.functions import taps as tp
from streakline.kernels import images as k
from streakline.sources import synthetic as sy


def test_worked_values():
    assert k.bin_columns(np.arange(1, 6.0)[None]).tolist() == [[3, 7, 10]]
    assert np.allclose(np.array([2, 4, 6, 8]) @ k.debin_matrix(8, 1), [1, 1.179688, 1.726562, 2.25, 2.75, 3.273438, 3.820312, 4], atol=1e-6)
    assert np.allclose((2 * np.ones(5) @ k.debin_matrix(9, 10))[-4:], [1.022919, 1.133587, 0.866413, 0.221398], atol=1e-6)
    assert np.allclose(k.filter_axis(np.arange(1, 6.0)[None], tp.gaussian(1), 1), [1.427041, 2.067688, 2.995434, 3.873621, 4.272431], atol=1e-6)
    assert k.running_median(np.array([5, 1, 4, 2, 3.0]), 3).tolist() == [5, 4, 2, 3, 3]
    assert np.allclose(tp.blend_window(8)[0, :4], [0.092709, 0.264013, 0.395124, 0.466081], atol=1e-6)
    assert np.allclose(tp.anisotropic_psd(8)[:3, 0], [1, 0.249352, 0.003866], atol=1e-6)
    assert [tp.number_of_scales(w) for w in (40, 80, 160, 640)] == [0, 1, 2, 3]
    kernel = k.residual_kernel()
    assert abs(kernel[32] - 0.75) < 0.01 and abs(kernel.sum() - 0.5) < 0.01


def test_hadamard_and_fft_round_trip():
    g = np.random.default_rng(1).normal(size=(3, 8, 8))
    for h in (False, True):
        assert np.allclose(k._patches(k._spectra(g, h), 8, h), g)
    assert np.allclose(k._patches(k._spectra(g[:, :5, :5], False), 5, False), g[:, :5, :5])


def plain_pass(noisy, pilot, p, wiener, sigma_map, psd):
    """One pass group by group, with whole complex transforms."""
    h, w = noisy.shape
    s, half = p.patch, p.window // 2
    num, den = np.zeros((h, w)), np.zeros((h, w))
    had = lambda x: k.HADAMARD_8 @ x @ k.HADAMARD_8
    for r0 in range(0, h - s + 1, p.step):
        for c0 in range(0, w - s + 1, p.step):
            cand = [(((pilot[r : r + s, c : c + s] - pilot[r0 : r0 + s, c0 : c0 + s]) ** 2).sum(), r, c) for r in range(max(0, r0 - half), min(r0 + half, h - s) + 1, p.step) for c in range(max(0, c0 - half), min(c0 + half, w - s) + 1, p.step) if (r, c) != (r0, c0)]
            at = [(r0, c0), *[(r, c) for _, r, c in sorted(cand)[: p.matches - 1]]]
            n = len(at)
            take = lambda x: np.array([x[r : r + s, c : c + s] for r, c in at])
            forward = (lambda g: np.fft.fft(had(g), axis=0)) if p.hadamard else np.fft.fftn
            z = forward(take(noisy))
            var = n * p.sigma_random**2 * s * s * np.ones((s, s))
            if psd is not None:
                var = var + n * n * s * s * (psd * sigma_map[c0]) ** 2
            if wiener:
                q = np.abs(forward(take(pilot))) ** 2
                gain = q / (q + var + 1e-8)
                weight = min(1e6, 1 / ((gain**2).sum() * p.sigma_random**2 + 1e-8))
            else:
                gain = (np.abs(z) ** 2 >= p.threshold**2 * var) * 1.0
                weight = 1 / (gain.sum() + 1)
            back = had(np.fft.ifft(z * gain, axis=0).real) / 64 if p.hadamard else np.fft.ifftn(z * gain).real
            for (r, c), patch in zip(at, back):
                num[r : r + s, c : c + s] += weight * tp.blend_window(s) * patch
                den[r : r + s, c : c + s] += weight * tp.blend_window(s)
    return np.where(den > 1e-6, num / np.where(den > 1e-6, den, 1), noisy)


@pytest.mark.parametrize("changes", [{}, {"hadamard": True}, {"window": 12, "matches": 5}, {"patch": 5, "step": 3, "window": 13, "matches": 7}])
@pytest.mark.parametrize("coloured", [False, True])
def test_passes_against_plain_loops(changes, coloured):
    a = np.random.default_rng(5).random((26, 31))
    p = k.Params(**changes)
    levels = k.sigma_profile(a)
    psd = tp.anisotropic_psd(p.patch) if coloured else None
    first, plain = k.collaborative_filter(a, a, p, False, levels, psd), plain_pass(a, a, p, False, levels, psd)
    assert np.allclose(first, plain)
    assert np.allclose(k.collaborative_filter(a, plain, p, True, levels, psd), plain_pass(a, plain, p, True, levels, psd))


@pytest.mark.parametrize("changes", [{}, {"window": 12}, {"patch": 6, "step": 3, "window": 20, "matches": 7}])
def test_tiles_give_the_whole(changes):
    a = np.random.default_rng(6).random((60, 91))
    r = k.prepare(a, "streak", k.Params(**changes))
    whole, out = k.two_passes(r.z, r.params, r.levels, r.psd), np.full(a.shape, np.nan)
    parts = k.tiles(*a.shape, 20, r.params)
    for inner, tile, cut in parts:
        out[inner[0] : inner[1], inner[2] : inner[3]] = k.two_passes(r.z[cut], r.params, r.levels[cut[1]], r.psd, tile, inner)
    assert len(parts) > 9 and np.allclose(out, whole, atol=1e-12)


def test_single_precision_stays():
    a = np.random.default_rng(7).random((40, 40))
    out = k.remove_rings(a.astype(np.float32), "streak", k.Params(threshold=0.0))
    assert out.dtype == np.float32 and np.allclose(out, k.remove_rings(a, "streak", k.Params(threshold=0.0)), atol=1e-3)
    assert k.multiscale(a.astype(np.float32)).dtype == np.float32


def test_constant_image_stays():
    assert np.allclose(k.remove_rings(np.full((32, 32), 42.5)), 42.5)


def test_single_stripe_and_profiles():
    a = np.full((64, 64), 0.5)
    a[:, 32] = 1
    assert k.remove_rings(a, "streak").mean(0).var() < a.mean(0).var()
    assert abs(int(np.argmax(k.streak_profile(a))) - 32) <= 2
    assert np.abs(k.streak_profile(np.full((32, 64), 0.5))).max() < 1e-5
    line = np.zeros((64, 64))
    line[32] = 1
    assert k.streak_profile(line).std() < 0.1


@pytest.mark.parametrize("shape", [(4, 8), (100, 10), (10, 200), (1, 32), (16, 16)])
def test_profile_shapes(shape):
    assert k.streak_profile(np.random.default_rng(0).random(shape)).shape == (shape[1],)


def test_streak_mode_beats_generic():
    clean, noisy = sy.benchmark_sinogram(256)
    psnr = lambda x: 10 * np.log10((clean.max() - clean.min()) ** 2 / ((x - clean) ** 2).mean())
    assert psnr(k.remove_rings(noisy, "streak")) - psnr(k.remove_rings(noisy, "generic")) > 3


def test_multiscale_adds_column_constants():
    a = np.full((64, 256), 0.5) + np.random.default_rng(3).normal(0, 0.01, (64, 256))
    a[:, 60:64] += 0.4
    out = k.multiscale(a, k.Params(sigma_random=0.5, threshold=3.5, debin_iterations=10))
    d = out - a
    assert (d.max(0) - d.min(0)).max() < 1e-9 and out.mean(0).var() < a.mean(0).var()


def test_fourier_svd_keeps_walls_and_removes_subtle_streaks():
    rng = np.random.default_rng(42)
    a = rng.normal(100, 1, (100, 100))
    a[:, 50] += 0.2
    out = k.fourier_svd(a)
    assert abs(out[:, 50].mean() - out[:, [49, 51]].mean()) < 1
    wall = np.zeros((100, 100))
    wall[:, 40:60] = 100
    assert k.fourier_svd(wall + rng.normal(0, 1, wall.shape))[:, 50].mean() > 90
    assert np.array_equal(k.fourier_svd(a[:5]), a[:5])


def test_noise_estimators():
    a = np.repeat(np.random.default_rng(42).normal(0, 0.05, (1, 4096)), 256, 0)
    assert abs(k.noise_sigma(a) / 0.05 - 1) < 0.1
    assert k.noise_sigma(np.zeros((8, 0))) == 0 and k.noise_sigma_robust(np.zeros((8, 64))) == 0
    assert k.even_columns(9, 3).tolist() == [0, 4, 8]


def test_match_rows_against_brute_force():
    a = np.random.default_rng(7).random((40, 44))
    for win, step in ((24, 4), (13, 3)):
        p = k.Params(window=win, step=step, matches=6)
        for r0 in range(0, 33, step):
            refs, mr, mc, d = k.match_rows(a, r0, p)
            for i, c0 in enumerate(refs):
                half = win // 2
                cand = [(((a[r : r + 8, c : c + 8] - a[r0 : r0 + 8, c0 : c0 + 8]) ** 2).sum(), r, c) for r in range(max(0, r0 - half), min(r0 + half, 32) + 1, step) for c in range(max(0, c0 - half), min(c0 + half, 36) + 1, step) if (r, c) != (r0, c0)]
                want = [(0.0, r0, c0), *sorted(cand)[:5]]
                assert [(r, c) for _, r, c in want] == list(zip(mr[i], mc[i]))
                assert np.allclose([x[0] for x in want], d[i])


def test_parameters_are_checked():
    for bad in ({"patch": 0}, {"hadamard": True, "patch": 4}, {"sigma_random": -1.0}):
        with pytest.raises(ValueError):
            k.remove_rings(np.eye(16), "generic", k.Params(**bad))
    with pytest.raises(ValueError):
        k.remove_rings(np.eye(16), "other")
