"""Registered queries of the image engine over the tables, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import taps as tp
from ..kernels import images as kn
from ..operators import neighbourhood as nb
from ..operators import pointwise as pw
from ..operators import stats as st
from ..sources import synthetic as sy
from ..sources import views as vw
from . import denoise as dn

QUERIES: dict = {}
SQL: dict[str, str] = {}

VIEWS = {
    "emb": ('img AS (SELECT 0 AS slice_id, CAST(vec_id AS INT) AS "row", CAST(i - 1 AS INT) AS col, CAST(e AS DOUBLE) AS value FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))', vw.embedding_image, vw.embedding_rows),
    "ev": (
        'fx AS (SELECT CAST(floor((epoch(ts) - 1704067200) / 3600) AS INT) AS "row", dense_rank() OVER (ORDER BY user_id) - 1 AS col, value FROM events), '
        'img AS (SELECT 0 AS slice_id, r."row", c.col, coalesce(f.value, 0) AS value FROM (SELECT DISTINCT "row" FROM fx) r CROSS JOIN (SELECT DISTINCT col FROM fx) c '
        'LEFT JOIN (SELECT "row", col, sum(value) AS value FROM fx GROUP BY ALL) f ON f."row" = r."row" AND f.col = c.col)',
        vw.event_image, vw.event_rows,
    ),
    "stack": (
        'fx AS (SELECT dense_rank() OVER (ORDER BY event_type) - 1 AS slice_id, CAST(floor((epoch(ts) - 1704067200) / 3600) AS INT) AS "row", dense_rank() OVER (ORDER BY user_id) - 1 AS col, value FROM events), '
        'img AS (SELECT s.slice_id, r."row", c.col, coalesce(f.value, 0) AS value FROM (SELECT DISTINCT slice_id FROM fx) s CROSS JOIN (SELECT DISTINCT "row" FROM fx) r CROSS JOIN (SELECT DISTINCT col FROM fx) c '
        'LEFT JOIN (SELECT slice_id, "row", col, sum(value) AS value FROM fx GROUP BY ALL) f ON f.slice_id = s.slice_id AND f."row" = r."row" AND f.col = c.col)',
        vw.event_stack, vw.event_stack_rows,
    ),
    "li": (
        'fx AS (SELECT (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS "row", dense_rank() OVER (ORDER BY l_suppkey) - 1 AS col, l_extendedprice AS value FROM lineitem), '
        'img AS (SELECT 0 AS slice_id, r."row", c.col, coalesce(f.value, 0) AS value FROM (SELECT DISTINCT "row" FROM fx) r CROSS JOIN (SELECT DISTINCT col FROM fx) c '
        'LEFT JOIN (SELECT "row", col, sum(value) AS value FROM fx GROUP BY ALL) f ON f."row" = r."row" AND f.col = c.col)',
        vw.lineitem_image, vw.lineitem_rows,
    ),
}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`").cast("long").alias(n) if t in ("int", "bigint") else F.col(f"`{n}`") for n, t in df.dtypes])


def query(name: str, view: str, sql: str | None = None, ints: str = "", floats: str = "", digits: int = 6, plain: bool = False):
    """Register fn(pixels): its SQL gets the view's CTE in front, its columns cast and rounded alike."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(VIEWS[view][1](spark, sf_dir)), digits)
        if sql is not None:
            cols = [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ints.split()] + [f'round(CAST("{c}" AS DOUBLE), {digits}) + 0.0 AS "{c}"' for c in floats.split()]
            SQL[name] = f"WITH {VIEWS[view][0]}, {'' if plain else 'res AS ('}{sql}{'' if plain else ')'} SELECT {', '.join(cols)} FROM res"
        return fn

    return register


PIX, PROFILE = "slice_id row col", "slice_id col"
query("image_stats", "emb", "SELECT slice_id, min(value) AS min_value, max(value) AS max_value, avg(value) AS mean_value, coalesce(stddev_samp(value), 0) AS std_value, count(*) AS n FROM img WHERE isfinite(value) GROUP BY slice_id", "slice_id n", "min_value max_value mean_value std_value")(st.image_stats)
query("roi_stats", "ev", 'SELECT slice_id, min(value) AS min_value, max(value) AS max_value, avg(value) AS mean_value, coalesce(stddev_samp(value), 0) AS std_value, count(*) AS n FROM img WHERE col BETWEEN 10 AND 60 AND "row" BETWEEN 100 AND 400 GROUP BY slice_id', "slice_id n", "min_value max_value mean_value std_value")(lambda p: st.image_stats(st.roi(p, 10, 100, 60, 400)))
_HIST = "e AS (SELECT slice_id, min(value) AS lo, max(value) AS hi FROM {src} GROUP BY slice_id), b AS (SELECT i.slice_id, CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / 64)), 63) ELSE 0 END AS bin, count(*) AS n FROM {src} i JOIN e ON e.slice_id = i.slice_id GROUP BY ALL), res AS (SELECT slice_id, bin, n, n / max(n) OVER (PARTITION BY slice_id) AS height FROM b)"
query("histogram_64", "emb", _HIST.format(src="img"), "slice_id bin n", "height", plain=True)(st.histogram)
query("roi_histogram", "emb", 'r AS (SELECT * FROM img WHERE col BETWEEN 8 AND 40 AND "row" BETWEEN 20 AND 200), ' + _HIST.format(src="r"), "slice_id bin n", "height", plain=True)(lambda p: st.histogram(st.roi(p, 8, 20, 40, 200)))
query("empirical_cdf", "li", "SELECT slice_id, row_number() OVER w AS i, value, (row_number() OVER w - 1) / (count(*) OVER (PARTITION BY slice_id) - 1) AS p FROM img WINDOW w AS (PARTITION BY slice_id ORDER BY value)", "slice_id i", "value p", 4)(st.empirical_cdf)
_MM = 'SELECT i.slice_id, "row", col, CASE WHEN hi - lo > 1e-10 THEN (value - lo) / (hi - lo) ELSE 0 END AS value, lo, hi FROM img i JOIN (SELECT slice_id, min(value) AS lo, max(value) AS hi FROM img GROUP BY slice_id) e ON e.slice_id = i.slice_id'
query("minmax_slice", "stack", _MM, PIX, "value lo hi")(pw.minmax_slice)
query("minmax_stack", "stack", 'SELECT slice_id, "row", col, (value - lo) / (hi - lo) AS value, lo, hi FROM img, (SELECT min(value) AS lo, max(value) AS hi FROM img) e', PIX, "value lo hi")(pw.minmax_stack)
query("denormalize", "stack", 'SELECT slice_id, "row", col, value FROM img', PIX, "value", 5)(lambda p: pw.denormalize(pw.minmax_slice(p)))
query("column_median", "emb", "SELECT slice_id, col, median(value) AS value FROM img GROUP BY ALL", PROFILE, "value")(st.column_median)
query("column_upper_median", "emb", "SELECT slice_id, col, list_sort(list(value))[count(*) // 2 + 1] AS value FROM img GROUP BY slice_id, col", PROFILE, "value")(st.column_upper_median)
_CV = "m AS (SELECT slice_id, col, list_sort(list(value))[count(*) // 2 + 1] AS median FROM img GROUP BY slice_id, col), cv AS (SELECT i.slice_id, i.col, any_value(median) AS median, avg((value - median) ** 2) AS variance FROM img i JOIN m ON m.slice_id = i.slice_id AND m.col = i.col GROUP BY i.slice_id, i.col)"
query("column_variance_about_median", "emb", _CV + ", res AS (FROM cv)", PROFILE, "median variance", plain=True)(st.column_variance_about_median)
query("centre_bias", "emb", "v AS (SELECT slice_id, col, var_pop(value) AS v FROM img GROUP BY slice_id, col), w AS (SELECT *, (max(col) OVER (PARTITION BY slice_id) + 1) // 4 AS q, max(col) OVER (PARTITION BY slice_id) + 1 AS w FROM v), res AS (SELECT slice_id, avg(v) FILTER (WHERE col >= q AND col < w - q) AS centre, avg(v) FILTER (WHERE col < q OR col >= w - q) AS edge, avg(v) FILTER (WHERE col >= q AND col < w - q) / avg(v) FILTER (WHERE col < q OR col >= w - q) AS ratio FROM w GROUP BY slice_id)", "slice_id", "centre edge ratio", plain=True)(st.centre_bias)
query("mad_sigma", "emb", "SELECT i.slice_id, any_value(m) AS median, median(abs(value - m)) AS mad FROM img i JOIN (SELECT slice_id, median(value) AS m FROM img GROUP BY slice_id) e ON e.slice_id = i.slice_id GROUP BY i.slice_id", "slice_id", "median mad")(st.mad)
query("robust_sigma", "emb", "m AS (SELECT slice_id, list_sort(list(value))[count(*) // 2 + 1] AS m, stddev_samp(value) AS sd FROM img GROUP BY slice_id), d AS (SELECT i.slice_id, any_value(sd) AS sd, list_sort(list(abs(value - m)))[count(*) // 2 + 1] AS mad FROM img i JOIN m ON m.slice_id = i.slice_id GROUP BY i.slice_id), res AS (SELECT slice_id, CASE WHEN mad > 0 THEN mad / 0.6745 ELSE sd END AS sigma FROM d)", "slice_id", "sigma", plain=True)(st.robust_sigma)
query("column_mean_abs", "emb", "SELECT slice_id, col, avg(abs(value)) AS value FROM img GROUP BY ALL", PROFILE, "value")(st.column_mean_abs)
query("even_column_sample", "emb", 'SELECT i.slice_id, i."row", s.i AS col, i.value FROM img i JOIN (SELECT i, i * (SELECT max(col) FROM img) // 9 AS src FROM range(10) r(i)) s ON s.src = i.col', PIX, "value")(lambda p: pw.even_columns(p, 10))
query("slice_axis_view", "stack", 'SELECT "row" AS slice_id, slice_id AS "row", col, value FROM img WHERE "row" = 100', PIX, "value")(lambda p: vw.slice_axis(p.select(F.col("slice_id").alias("d0"), F.col("row").alias("d1"), F.col("col").alias("d2"), "value"), "d1", "d0", "d2", 100))
query("window_level", "li", 'SELECT slice_id, "row", col, greatest(0, least(1, (value - 50000) / 400000)) AS value FROM img', PIX, "value", 9)(lambda p: pw.window_level(p, 50000.0, 450000.0))
query("grayscale_u8", "emb", 'SELECT i.slice_id, "row", col, trunc((value - lo) / (hi - lo) * 255) AS value FROM img i JOIN (SELECT slice_id, min(value) AS lo, max(value) AS hi FROM img GROUP BY slice_id) e ON e.slice_id = i.slice_id', PIX + " value")(pw.grayscale_u8)
query("percentile_stretch", "emb", 'SELECT i.slice_id, "row", col, trunc(greatest(0, least(1, (value - lo) / (hi - lo))) * 255) AS value FROM img i JOIN (SELECT slice_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM img GROUP BY slice_id) e ON e.slice_id = i.slice_id', PIX + " value")(pw.percentile_stretch)
_SUB = 's AS (SELECT i.slice_id, i."row", i.col, value - m AS value FROM img i JOIN (SELECT slice_id, col, median(value) AS m FROM img GROUP BY ALL) p ON p.slice_id = i.slice_id AND p.col = i.col)'
query("subtract_profile", "emb", _SUB + ", res AS (FROM s)", PIX, "value", plain=True)(lambda p: pw.subtract_profile(p, st.column_median(p)))
query("difference", "emb", _SUB + ', res AS (SELECT i.slice_id, i."row", i.col, i.value - s.value AS value FROM img i JOIN s ON s.slice_id = i.slice_id AND s."row" = i."row" AND s.col = i.col)', PIX, "value", plain=True)(lambda p: pw.difference(p, pw.subtract_profile(p, st.column_median(p))))
query("mae_mse_psnr", "emb", _SUB + ', b AS (SELECT i.slice_id, i.value AS x, s.value AS y FROM img i JOIN s ON s.slice_id = i.slice_id AND s."row" = i."row" AND s.col = i.col), res AS (SELECT slice_id, avg(abs(x - y)) AS mae, avg((x - y) ** 2) AS mse, 10 * log10((max(x) - min(x)) ** 2 / avg((x - y) ** 2)) AS psnr FROM b GROUP BY slice_id)', "slice_id", "mae mse psnr", plain=True)(lambda p: st.error_metrics(p, pw.subtract_profile(p, st.column_median(p))))
query("column_argmax", "emb", "p AS (SELECT slice_id, col, median(value) AS value FROM img GROUP BY ALL), res AS (SELECT slice_id, arg_max(col, value) AS col, max(value) AS value FROM p GROUP BY slice_id)", PROFILE, "value", plain=True)(lambda p: st.column_argmax(st.column_median(p)))
query("diverging_range", "emb", "SELECT slice_id, -max(abs(value)) AS lo, max(abs(value)) AS hi FROM img GROUP BY slice_id", "slice_id", "lo hi")(pw.diverging_range)
_LEVEL = 'e AS (SELECT slice_id, max(abs(value)) AS m FROM img GROUP BY slice_id), l AS (SELECT i.slice_id, "row", col, greatest(0, least(255, trunc((CASE WHEN m > 0 THEN value / m ELSE 0 END + 1) * 0.5::DOUBLE * 255))) / 255.0::DOUBLE * 2 - 1 AS t FROM img i JOIN e ON e.slice_id = i.slice_id), '
query("colormap_diverging", "emb", _LEVEL + 'res AS (SELECT slice_id, "row", col, trunc(CASE WHEN t < 0 THEN 33 + (1 + t) * (255 - 33) ELSE 255 END) AS red, trunc(CASE WHEN t < 0 THEN 102 + (1 + t) * (255 - 102) ELSE 255 - t * (255 - 58) END) AS green, trunc(CASE WHEN t < 0 THEN 172 + (1 + t) * (255 - 172) ELSE 255 - t * (255 - 56) END) AS blue FROM l)', PIX + " red green blue", plain=True)(pw.diverging_colors)
_SEQ = 'e AS (SELECT slice_id, min(value) AS lo, max(value) AS hi FROM img GROUP BY slice_id), l AS (SELECT i.slice_id, "row", col, trunc(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END * 255) / 255.0::DOUBLE AS t FROM img i JOIN e ON e.slice_id = i.slice_id), '


def _knots(points: tuple) -> str:
    """SQL of a colour's channels: linear between five even knots, truncated."""
    one = lambda c: " ".join(f"WHEN t < {(k + 1) / 4}::DOUBLE OR {k} = 3 THEN {points[k][c]} + (t - {k / 4}::DOUBLE) / 0.25::DOUBLE * ({points[k + 1][c]} - {points[k][c]})" for k in range(4))
    return ", ".join(f"trunc(CASE {one(c)} END) AS {name}" for c, name in enumerate(("red", "green", "blue")))


for _name, _points in pw.SEQUENTIAL.items():
    query(f"colormap_{_name}", "emb", _SEQ + f'res AS (SELECT slice_id, "row", col, {_knots(_points)} FROM l)', PIX + " red green blue", plain=True)(lambda p, n=_name: pw.sequential_colors(p, n))


def _taps(sigma: float, name: str = "taps") -> str:
    return f"{name} AS (SELECT k, exp(-0.5 * (k / {sigma}::DOUBLE) ** 2) / sum(exp(-0.5 * (k / {sigma}::DOUBLE) ** 2)) OVER () AS w FROM range(-ceil(4 * {sigma})::BIGINT, ceil(4 * {sigma})::BIGINT + 1) r(k))"


def _given(taps, name: str = "taps") -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(f'({i - 3}, {w}::DOUBLE)' for i, w in enumerate(taps))}) v(k, w))"


def _filter(src: str, axis: str, out: str, boundary: str = "reflect", taps: str = "taps") -> str:
    """SQL of a filter along col or row: each target meets each tap's source."""
    other = '"row"' if axis == "col" else "col"
    a = '"row"' if axis == "row" else "col"
    i, n = f"(t.{a} + k)", "n.n"
    index = f"CASE WHEN {i} < 0 THEN least(-{i} - 1, {n} - 1) WHEN {i} >= {n} THEN greatest(2 * {n} - 2 - {i}, 0) ELSE {i} END" if boundary == "reflect" else f"greatest(0, least({i}, {n} - 1))"
    return f"{out} AS (SELECT t.slice_id, t.{other}, t.{a}, sum(w * s.value) AS value FROM {src} t CROSS JOIN (SELECT max({a}) + 1 AS n FROM {src}) n CROSS JOIN {taps} JOIN {src} s ON s.slice_id = t.slice_id AND s.{other} = t.{other} AND s.{a} = {index} GROUP BY t.slice_id, t.{other}, t.{a})"


_RES = ', res AS (SELECT slice_id, "row", col, value FROM {})'
_B2 = f"{_taps(3.0)}, {_filter('img', 'col', 'bx')}, {_filter('bx', 'row', 'b2')}"
query("gaussian_rows", "emb", f"{_taps(1.0)}, {_filter('img', 'col', 'b')}{_RES.format('b')}", PIX, "value", plain=True)(lambda p: nb.gaussian_rows(p, 1.0))
query("gaussian_2d", "emb", _B2 + _RES.format("b2"), PIX, "value", plain=True)(lambda p: nb.gaussian_2d(p, 3.0, 3.0))
query("db3_highpass", "emb", f"{_given(tp.DB3_HIGH)}, {_filter('img', 'col', 'b', 'clamp')}{_RES.format('b')}", PIX, "value", plain=True)(nb.db3_highpass)
query("fir_db3_robust", "emb", f"{_taps(2.0, 'g')}, {_given(tp.DB3_ROBUST)}, {_filter('img', 'row', 'v', 'clamp', 'g')}, {_filter('v', 'col', 'b', 'clamp')}{_RES.format('b')}", PIX, "value", plain=True)(nb.fir_db3_robust)
query("running_median_51", "ev", "p AS (SELECT slice_id, col, median(value) + avg(value) AS value FROM img GROUP BY ALL), res AS (SELECT t.slice_id, t.col, median(s.value) AS value FROM p t CROSS JOIN range(-25, 26) r(k) JOIN p s ON s.slice_id = t.slice_id AND s.col = greatest(0, least(t.col + k, (SELECT max(col) FROM p))) GROUP BY t.slice_id, t.col)", PROFILE, "value", plain=True)(lambda p: nb.running_median(p.groupBy("slice_id", "col").agg((F.median("value") + F.avg("value")).alias("value")), 51))


def _streak(sigma: float, src: str = "img") -> str:
    """SQL of one iteration of the streak profile (CTE prof)."""
    return f"{_taps(3.0, 'gx')}, {_taps(sigma, 'gy')}, {_taps(1.0, 'g1')}, {_filter(src, 'col', 'sx', taps='gx')}, {_filter('sx', 'row', 'sm', taps='gy')}, med AS (SELECT i.slice_id, 0 AS \"row\", i.col, median(i.value - sm.value) AS value FROM {src} i JOIN sm ON sm.slice_id = i.slice_id AND sm.\"row\" = i.\"row\" AND sm.col = i.col GROUP BY i.slice_id, i.col), {_filter('med', 'col', 'prof', taps='g1')}"


query("streak_profile_1", "emb", _streak(3.0) + ", res AS (SELECT slice_id, col, value FROM prof)", PROFILE, "value", plain=True)(lambda p: nb.streak_profile(p, 3.0, 1))
query("sigma_profile", "emb", f"{_streak(5.0)}, {_taps(20.0, 'g20')}, {_filter('prof', 'col', 'pb', taps='g20')}, res AS (SELECT prof.slice_id, prof.col, abs(prof.value - pb.value) * 1.1::DOUBLE AS value FROM prof JOIN pb ON pb.slice_id = prof.slice_id AND pb.col = prof.col)", PROFILE, "value", plain=True)(nb.sigma_profile)
query("destreaked", "emb", _streak(3.0) + ', res AS (SELECT i.slice_id, i."row", i.col, i.value - p.value AS value FROM img i JOIN prof p ON p.slice_id = i.slice_id AND p.col = i.col)', PIX, "value", plain=True)(nb.remove_streak_profile)
query("integral_image", "emb", 'a AS (SELECT *, sum(value) OVER w AS s, sum(value * value) OVER w AS q FROM img WINDOW w AS (PARTITION BY slice_id, "row" ORDER BY col)), res AS (SELECT slice_id, "row", col, sum(s) OVER w AS total, sum(q) OVER w AS squares FROM a WINDOW w AS (PARTITION BY slice_id, col ORDER BY "row"))', PIX, "total squares", plain=True)(nb.integral_image)
query("patch_sums", "emb", 'a AS (SELECT *, sum(value) OVER w AS s, count(*) OVER w AS n FROM img WINDOW w AS (PARTITION BY slice_id, "row" ORDER BY col ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)), b AS (SELECT slice_id, "row", col, sum(s) OVER w AS value, count(*) OVER w AS m FROM a WHERE n = 8 WINDOW w AS (PARTITION BY slice_id, col ORDER BY "row" ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)), res AS (FROM b WHERE m = 8)', PIX, "value", plain=True)(nb.patch_sums)
query(
    "match_patches_topk", "emb",
    'a AS (SELECT *, list(value) OVER w AS s FROM img WINDOW w AS (PARTITION BY slice_id, "row" ORDER BY col ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)), '
    'b AS (SELECT slice_id, "row", col, list(s) OVER w AS b FROM a WHERE len(s) = 8 AND col % 4 = 0 WINDOW w AS (PARTITION BY slice_id, col ORDER BY "row" ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)), '
    'g AS (SELECT slice_id, "row", col, flatten(b) AS p FROM b WHERE len(b) = 8 AND "row" % 4 = 0), '
    'd AS (SELECT r.slice_id, r."row" AS ref_row, r.col AS ref_col, c."row", c.col, list_distance(r.p, c.p) ** 2 AS distance FROM g r JOIN g c ON c.slice_id = r.slice_id AND c."row" BETWEEN r."row" - 12 AND r."row" + 12 AND c.col BETWEEN r.col - 12 AND r.col + 12), '
    'k AS (SELECT *, row_number() OVER (PARTITION BY slice_id, ref_row, ref_col ORDER BY CASE WHEN "row" = ref_row AND col = ref_col THEN 0 ELSE 1 END, distance, "row", col) AS rank FROM d), res AS (FROM k WHERE rank <= 16)',
    "slice_id ref_row ref_col rank row col", "distance", plain=True,
)(nb.match_patches)
query("bin_horizontal", "ev", 'SELECT slice_id, "row", col // 2 AS col, sum(value * CASE WHEN (SELECT max(col) FROM img) % 2 = 0 AND col = (SELECT max(col) FROM img) THEN 2 ELSE 1 END) AS value FROM img GROUP BY slice_id, "row", col // 2', PIX, "value")(nb.bin_horizontal)


def _debin(pixels: DataFrame) -> DataFrame:
    profile = nb.bin_horizontal(pixels.groupBy("slice_id", "col").agg(F.avg("value").alias("value")).select("slice_id", F.lit(0).alias("row"), "col", "value"))
    return nb.apply_column_matrix(profile, kn.debin_matrix(64, 1))


_KNOT = lambda off: f"coalesce((SELECT v FROM b WHERE b.c = greatest(0, least(31, x.i + {off}))), 0)"
query("debin_once", "emb", f"b AS (SELECT col // 2 AS c, sum(value) / 2 AS v FROM (SELECT col, avg(value) AS value FROM img GROUP BY col) GROUP BY 1), x AS (SELECT col, t, greatest(0, least(floor((t - 1.5) / 2), 30))::INT AS i FROM (SELECT c0 AS col, greatest(1.5, least(c0 + 1, 63.5))::DOUBLE AS t FROM range(64) r(c0))), y AS (SELECT col, (t - 1.5 - 2 * i) / 2 AS t, {_KNOT(-1)} AS p0, {_KNOT(0)} AS p1, {_KNOT(1)} AS p2, {_KNOT(2)} AS p3 FROM x), res AS (SELECT 0 AS slice_id, 0 AS \"row\", col, 0.5::DOUBLE * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t ** 2 + (3 * p1 - p0 - 3 * p2 + p3) * t ** 3) AS value FROM y)", PIX, "value", plain=True)(_debin)
query("cluster_gate", "ev", "p AS (SELECT slice_id, col, avg(value) - 8 AS value FROM img GROUP BY ALL), o AS (SELECT *, abs(value) > 0.5 AS is_on, sum(CASE WHEN abs(value) > 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY slice_id ORDER BY col) AS island FROM p), z AS (SELECT *, count(*) FILTER (WHERE is_on) OVER (PARTITION BY slice_id, island) AS n, max(abs(value)) FILTER (WHERE is_on) OVER (PARTITION BY slice_id, island) AS peak FROM o), res AS (SELECT slice_id, col, CASE WHEN is_on AND n > 4 AND peak > 1 THEN 0 ELSE value END AS value FROM z)", PROFILE, "value", plain=True)(lambda p: nb.cluster_gate(p.groupBy("slice_id", "col").agg((F.avg("value") - 8).alias("value")), 1.0, high=1.0, width=4))
query("coarse_max_variance", "ev", _CV + ", res AS (SELECT slice_id, col >> 1 AS col, max(variance) AS value FROM cv GROUP BY ALL)", PROFILE, "value", 4, plain=True)(lambda p: nb.coarse_max_variance(p, 1))
query("saliency_gate", "emb", _CV + ", f AS (SELECT slice_id, col >> 1 AS col, max(variance) AS v FROM cv GROUP BY ALL), res AS (SELECT cv.slice_id, cv.col, median * CASE WHEN median ** 2 + variance > 0 AND f.v <= 200 THEN (median ** 2 / (median ** 2 + variance)) ** 8 ELSE 0 END AS value FROM cv JOIN f ON f.slice_id = cv.slice_id AND f.col = cv.col)", PROFILE, "value", plain=True)(lambda p: nb.saliency_gate(p, p, 1, 10.0))
query("soft_gate", "emb", "SELECT slice_id, col, m / (1 + (abs(m) / 0.06::DOUBLE) ** 6) AS value FROM (SELECT slice_id, col, median(value) AS m FROM img GROUP BY ALL)", PROFILE, "value")(lambda p: pw.soft_gate(st.column_median(p), 0.02))


def _power_sql(rounds: int) -> str:
    parts, v = ["v0 AS (SELECT slice_id, col, 1 / sqrt(count(*) OVER (PARTITION BY slice_id)) AS v FROM (SELECT DISTINCT slice_id, col FROM img))"], "v0"
    for k in range(1, rounds + 1):
        parts.append(f'a{k} AS (SELECT i.slice_id, "row", sum(value * v) AS u FROM img i JOIN {v} v ON v.slice_id = i.slice_id AND v.col = i.col GROUP BY i.slice_id, "row"), u{k} AS (SELECT slice_id, "row", u / sqrt(sum(u * u) OVER (PARTITION BY slice_id)) AS u FROM a{k})')
        parts.append(f'b{k} AS (SELECT i.slice_id, col, sum(value * u) AS v FROM img i JOIN u{k} u ON u.slice_id = i.slice_id AND u."row" = i."row" GROUP BY i.slice_id, col), v{k} AS (SELECT slice_id, col, v / sqrt(sum(v * v) OVER (PARTITION BY slice_id)) AS v, sqrt(sum(v * v) OVER (PARTITION BY slice_id)) AS s FROM b{k})')
        v = f"v{k}"
    return ", ".join(parts) + f", res AS (SELECT slice_id, col, v AS value, s AS singular_value FROM {v})"


query("power_iteration_k", "ev", _power_sql(3), PROFILE, "value singular_value", plain=True)(lambda p: nb.power_iteration(p, 3))
query("dft8_group", "emb", 'SELECT a.slice_id, a."row", a.col // 8 * 8 + u AS col, sum(value * cos(2 * pi() * u * (a.col % 8) / 8)) AS re, -sum(value * sin(2 * pi() * u * (a.col % 8) / 8)) AS im FROM img a, range(8) r(u) GROUP BY a.slice_id, a."row", a.col // 8, u', PIX, "re im", digits=5)(nb.dft_rows)
query("wht8_patch", "emb", 'SELECT a.slice_id, a."row" // 8 * 8 + y AS "row", a.col // 8 * 8 + u AS col, sum(value * (1 - 2 * (bit_count((u & (a.col % 8))::INT) % 2)) * (1 - 2 * (bit_count((y & (a."row" % 8))::INT) % 2))) AS value FROM img a, range(8) r(u), range(8) t(y) WHERE a."row" // 8 < (SELECT (max("row") + 1) // 8 FROM img) GROUP BY a.slice_id, a."row" // 8, y, a.col // 8, u', PIX, "value")(nb.wht_patches)


def _blocks(pixels: DataFrame) -> DataFrame:
    """Shifted copies with place-dependent weights, as blocks that overlap; columns from 48 on stay uncovered."""
    shifted = pixels.filter("col < 40").withColumn("shift", F.explode(F.array(F.lit(0), F.lit(4), F.lit(8))))
    return shifted.select("slice_id", "row", (F.col("col") + F.col("shift")).alias("col"), "value", (1.0 + F.col("col") % 3 + F.col("shift")).alias("weight"))


query("overlap_add", "emb", 'b AS (SELECT slice_id, "row", col + s AS col, value, 1 + col % 3 + s AS w FROM img, (VALUES (0), (4), (8)) v(s) WHERE col < 40), a AS (SELECT slice_id, "row", col, sum(value * w) / sum(w) AS v FROM b GROUP BY ALL), res AS (SELECT i.slice_id, i."row", i.col, coalesce(v, value) AS value FROM img i LEFT JOIN a ON a.slice_id = i.slice_id AND a."row" = i."row" AND a.col = i.col)', PIX, "value", plain=True)(lambda p: nb.overlap_add(_blocks(p), p))
query("flagship_destreak_stats", "emb", _streak(3.0) + ", c AS (SELECT i.slice_id, i.col, i.value - p.value AS value FROM img i JOIN prof p ON p.slice_id = i.slice_id AND p.col = i.col), res AS (SELECT slice_id, col, min(value) AS min_value, max(value) AS max_value, avg(value) AS mean_value, stddev_samp(value) AS std_value, count(*) AS n FROM c GROUP BY ALL)", "slice_id col n", "min_value max_value mean_value std_value", plain=True)(
    lambda p: nb.remove_streak_profile(p).groupBy("slice_id", "col").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("std_value"), F.count("*").alias("n"))
)


def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct()
    return names.select("source", F.row_number().over(Window.orderBy(tp.natural_key(F.col("source")))).cast("long").alias("place"))


QUERIES["natural_sort"] = natural_sort
SQL["natural_sort"] = "SELECT source, row_number() OVER (ORDER BY regexp_extract(source, '^\\D*'), CAST(regexp_extract(source, '\\d+') AS BIGINT)) AS place FROM (SELECT DISTINCT source FROM documents)"


def phantom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sy.shepp_logan(spark, 128))


QUERIES["shepp_logan"] = phantom
SQL["shepp_logan"] = (
    "WITH e AS (SELECT * FROM (VALUES " + ", ".join(str(e) for e in sy.ELLIPSES) + ") t(v, a, b, x0, y0, deg)), "
    'g AS (SELECT r AS "row", c AS col, c * (2.0::DOUBLE / 127) - 1 AS x, 1 - r * (2.0::DOUBLE / 127) AS y FROM range(128) s(r), range(128) t(c)), '
    'i AS (SELECT "row", col, sum(CASE WHEN (((x - x0) * cos(radians(deg)) + (y - y0) * sin(radians(deg))) / a) ** 2 + (((y - y0) * cos(radians(deg)) - (x - x0) * sin(radians(deg))) / b) ** 2 <= 1 THEN v ELSE 0 END)::DOUBLE AS value FROM g, e GROUP BY ALL), '
    'm AS (SELECT min(value) AS lo, max(value) AS hi FROM i) SELECT 0::BIGINT AS slice_id, "row"::BIGINT AS "row", col::BIGINT AS col, round((value - lo) / (hi - lo), 6) + 0.0 AS value FROM i, m'
)


def kernel(name: str, view: str, fn):
    """Register a kernel on slices; its pixels are returned."""
    QUERIES[name] = lambda spark, sf_dir: fn(vw.rows_to_slices(VIEWS[view][2](spark, sf_dir)))


#: Views hold few images, so their tiles are shared out.
SIDE = 512
kernel("noise_sigma", "ev", lambda s: dn.noise_sigma(s))
kernel("noise_sigma_robust", "ev", lambda s: dn.noise_sigma(s, robust=True))
QUERIES["match_patches_kernel"] = lambda spark, sf_dir: dn.matches_of_rows(vw.embedding_rows(spark, sf_dir))
kernel("hard_threshold_pass", "emb", lambda s: vw.from_slices(dn.filter_pass(s, False)))
kernel("wiener_pass", "emb", lambda s: vw.from_slices(dn.filter_pass(s, True)))
kernel("remove_streaks_generic", "emb", lambda s: vw.from_slices(dn.remove_streaks(s, "generic", side=SIDE), dealt=True))
kernel("remove_streaks_streak", "emb", lambda s: vw.from_slices(dn.remove_streaks(s, "streak", side=SIDE), dealt=True))
QUERIES["remove_streaks_stack"] = lambda spark, sf_dir: dn.remove_streaks_strips(vw.event_stack_rows(spark, sf_dir), side=SIDE)
kernel("remove_streaks_multiscale", "ev", lambda s: vw.from_slices(dn.remove_streaks(s, multiscale=True, params=dn.parameters("multiscale"), side=SIDE), dealt=True))
kernel("remove_streaks_hadamard", "emb", lambda s: vw.from_slices(dn.remove_streaks(s, "streak", dn.parameters(hadamard=True), side=SIDE), dealt=True))
kernel("fourier_svd", "emb", lambda s: vw.from_slices(dn.fourier_svd(s)))
QUERIES["radon_sinogram"] = lambda spark, sf_dir: sy.sinogram(vw.to_slices(sy.shepp_logan(spark, 64)), 4.0)
QUERIES["detector_gain"] = lambda spark, sf_dir: sy.detector_gain(vw.embedding_image(spark, sf_dir), error=0.05)
