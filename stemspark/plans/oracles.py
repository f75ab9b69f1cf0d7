"""SQL that gives the same rows as the catalog's queries, on the same tables, in another engine's dialect."""

from __future__ import annotations

_SIZE = """
cnt AS (SELECT count(*) AS n FROM embeddings),
sz AS (SELECT CAST(max(i) AS INTEGER) AS sh, CAST(max(n) // max(i) AS INTEGER) AS sw FROM (SELECT n, unnest(range(1, CAST(floor(sqrt(n)) AS BIGINT) + 1)) AS i FROM cnt) WHERE n % i = 0)"""


def _frames(name: str, h: int, w: int) -> str:
    return f"""{_SIZE},
fr AS (SELECT '{name}' AS dataset_id, vec_id AS frame_idx, CAST(vec_id // sw AS INTEGER) AS scan_y, CAST(vec_id % sw AS INTEGER) AS scan_x, {h} AS det_h, {w} AS det_w,
  list_transform(embedding, lambda v: CAST(round((CAST(v AS DOUBLE) + 1) * 1000) AS INTEGER)) AS counts FROM embeddings, sz),
vx AS (SELECT dataset_id, frame_idx, scan_y, scan_x, CAST((p - 1) // {w} AS INTEGER) AS det_y, CAST((p - 1) % {w} AS INTEGER) AS det_x, counts[p] AS count FROM (SELECT *, unnest(range(1, {h * w + 1})) AS p FROM fr))"""


_FRAMES, _EELS = _frames("emb", 8, 8), _frames("eels", 4, 16)
_DAMAGED = _FRAMES + ", dm AS (SELECT * REPLACE (CASE WHEN (frame_idx * 64 + det_y * 8 + det_x) % 97 = 0 THEN 0 ELSE count END AS count) FROM vx)"
_CONTEXT = _SIZE + ", cx AS (SELECT 'emb' AS dataset_id, CAST(vec_id // sw AS INTEGER) AS y, CAST(vec_id % sw AS INTEGER) AS x, CAST(label AS INTEGER) AS value FROM embeddings, sz)"
_EVENTS = """
ocnt AS (SELECT count(*) AS n FROM orders),
osz AS (SELECT max(n) // max(i) AS sw FROM (SELECT n, unnest(range(1, CAST(floor(sqrt(n)) AS BIGINT) + 1)) AS i FROM ocnt) WHERE n % i = 0),
ev AS (SELECT 'events' AS dataset_id, CAST(k // sw AS INTEGER) AS scan_y, CAST(k % sw AS INTEGER) AS scan_x, CAST(p // 16 AS INTEGER) AS det_y, CAST(p % 16 AS INTEGER) AS det_x, count
  FROM (SELECT l_orderkey AS k, l_partkey % 256 AS p, CAST(sum(l_quantity) AS BIGINT) AS count FROM lineitem GROUP BY ALL), osz)"""
_DATASETS = """
ds AS (SELECT CAST(p_partkey AS VARCHAR) AS dataset_id, p_partkey + 1 AS n_frames, CAST(2 ** (1 + p_size % 9) AS INTEGER) AS det_h,
  CAST(2 ** (1 + p_size % 9) * CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 1 END AS INTEGER) AS det_w FROM part),
dz AS (SELECT *, n_frames * (384 + 2 * CAST(det_h AS BIGINT) * det_w) AS file_size FROM ds)"""
_RUNS = "rn AS (SELECT o_orderkey AS run_id, o_custkey AS dataset_id, o_orderdate AS ts, CAST(o_orderkey % 5 + 1 AS INTEGER) AS step_completed FROM orders)"
_STAGES = (
    _RUNS
    + """,
st AS (SELECT run_id, CAST(k + 1 AS INTEGER) AS step, ['detect', 'bigft', 'correlations', 'shifts', 'reconstruction'][k + 1] AS stage, (run_id % 1000) * (k + 1) AS size_bytes
  FROM (SELECT run_id, unnest(range(0, 5)) AS k FROM rn) WHERE (run_id + k) % 3 <> 0)"""
)
_ARRIVALS = """
ar AS (SELECT event_type AS dataset_id, event_id AS frame_idx, ts FROM events),
ad AS (SELECT DISTINCT dataset_id, (SELECT count(*) FROM events) AS n_frames FROM ar)"""
_PATTERN = _FRAMES + ", pt AS (SELECT dataset_id, det_y, det_x, CAST(sum(count) AS BIGINT) AS value FROM vx GROUP BY ALL)"
_SHIFTS = (
    _PATTERN
    + """,
sf AS (SELECT dataset_id, det_y, det_x, (value % 9 - 4) / 2.0::DOUBLE + sh // 2 AS shift_y, (value % 7 - 3) / 2.0::DOUBLE + sw // 2 AS shift_x, (value % 100) / 100.0::DOUBLE AS quality FROM pt, sz),
ce AS (SELECT dataset_id, det_y, det_x, shift_y - sh // 2 AS shift_y, shift_x - sw // 2 AS shift_x, quality FROM sf, sz)"""
)
_DFT = (
    _FRAMES
    + """,
ks AS (SELECT ky, unnest(range(0, sw)) AS kx, sw FROM (SELECT unnest(range(0, sh)) AS ky, sw FROM sz)),
ft AS (SELECT dataset_id, det_y, det_x, CAST(ky AS INTEGER) AS ky, CAST(kx AS INTEGER) AS kx, sum(count * cos(a)) AS re, -sum(count * sin(a)) AS im
  FROM (SELECT v.*, ky, kx, 2 * pi() * (ky * scan_y / sh + kx * scan_x / CAST(sz.sw AS DOUBLE)) AS a FROM vx v, ks, sz) GROUP BY dataset_id, det_y, det_x, ky, kx)"""
)


def _disk(inside: str, y: str = "det_y", x: str = "det_x") -> str:
    return inside.format(d=f"(({x} - 4) * ({x} - 4) + ({y} - 4) * ({y} - 4))")


#: Every image smoothed along both axes (sigma 0.5, two places to each side, mirrored ends).
_SMOOTH = """
kr AS (SELECT k, exp(-2.0 * k * k) / (SELECT sum(exp(-2.0 * j * j)) FROM (SELECT unnest(range(-2, 3)) AS j)) AS w FROM (SELECT unnest(range(-2, 3)) AS k)),
ya AS (SELECT y, k, w, CASE WHEN y + k < 0 THEN -1 - y - k WHEN y + k >= sh THEN 2 * sh - 1 - y - k ELSE y + k END AS src FROM (SELECT unnest(range(0, sh)) AS y, sh FROM sz), kr),
xa AS (SELECT x, k, w, CASE WHEN x + k < 0 THEN -1 - x - k WHEN x + k >= sw THEN 2 * sw - 1 - x - k ELSE x + k END AS src FROM (SELECT unnest(range(0, sw)) AS x, sw FROM sz), kr),
va AS (SELECT det_y, det_x, y, scan_x, sum(w * count) AS c FROM vx JOIN ya ON scan_y = src GROUP BY ALL),
sm AS (SELECT det_y, det_x, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, sum(w * c) AS value FROM va JOIN xa ON scan_x = src GROUP BY ALL)"""

def _shifts_to(ref: str, k: str = "") -> str:
    """Correlations of every image with a reference (y, x, r) at every lag, their greatest, and its place refined: sq."""
    return f"""
ref{k} AS ({ref}),
pr{k} AS (SELECT ly, lx, y, x, r, (y + ly) % sh AS py, (x + lx) % sw AS px FROM ref{k}, lg, sz),
cc{k} AS (SELECT det_y, det_x, ly, lx, sum(count * r) AS c FROM pr{k} JOIN vx ON scan_y = py AND scan_x = px GROUP BY ALL),
nm{k} AS (SELECT det_y, det_x, sum(count * count) * (SELECT sum(r * r) FROM ref{k}) AS norm FROM vx GROUP BY ALL),
co{k} AS (SELECT det_y, det_x, CAST((ly + sh // 2) % sh AS INTEGER) AS lag_y, CAST((lx + sw // 2) % sw AS INTEGER) AS lag_x, c * c / norm AS corr FROM cc{k} JOIN nm{k} USING (det_y, det_x), sz),
pk{k} AS (SELECT det_y, det_x, lag_y AS peak_y, lag_x AS peak_x, corr AS peak FROM (SELECT *, row_number() OVER (PARTITION BY det_y, det_x ORDER BY round(corr, 12) DESC, lag_y, lag_x) AS k FROM co{k}) WHERE k = 1),
nb{k} AS (SELECT p.*, max(CASE WHEN lag_y = peak_y - 1 AND lag_x = peak_x THEN corr END) AS up, max(CASE WHEN lag_y = peak_y + 1 AND lag_x = peak_x THEN corr END) AS down,
  max(CASE WHEN lag_y = peak_y AND lag_x = peak_x - 1 THEN corr END) AS "left", max(CASE WHEN lag_y = peak_y AND lag_x = peak_x + 1 THEN corr END) AS "right",
  max(CASE WHEN lag_y = peak_y - 1 AND lag_x = peak_x - 1 THEN corr END) AS c00, max(CASE WHEN lag_y = peak_y - 1 AND lag_x = peak_x + 1 THEN corr END) AS c02,
  max(CASE WHEN lag_y = peak_y + 1 AND lag_x = peak_x - 1 THEN corr END) AS c20, max(CASE WHEN lag_y = peak_y + 1 AND lag_x = peak_x + 1 THEN corr END) AS c22
  FROM pk{k} p JOIN co{k} USING (det_y, det_x) GROUP BY ALL),
si{k} AS (SELECT *, peak_y BETWEEN 1 AND sh - 2 AND peak_x BETWEEN 1 AND sw - 2 AS inside, down - 2 * peak + up AS dyy, "right" - 2 * peak + "left" AS dxx FROM nb{k}, sz),
sq{k} AS (SELECT det_y, det_x, CASE WHEN inside THEN peak_y - coalesce((down - up) / nullif(CASE WHEN dyy <= 1e-3 THEN dyy ELSE 1e6 END, 0), 0) / 2 ELSE peak_y END AS shift_y,
  CASE WHEN inside THEN peak_x - coalesce(("right" - "left") / nullif(CASE WHEN dxx <= 1e-3 THEN dxx ELSE 1e6 END, 0), 0) / 2 ELSE peak_x END AS shift_x, peak AS quality FROM si{k})"""


_LAGS = "lg AS (SELECT ly, unnest(range(0, sw)) AS lx FROM (SELECT unnest(range(0, sh)) AS ly, sw FROM sz))"
_CORR = f"{_FRAMES},{_SMOOTH},\n{_LAGS}," + _shifts_to("SELECT y, x, value AS r FROM sm WHERE det_y = 4 AND det_x = 4")
#: Reference from two opposing pixels: the second's shift against the first, each image moved by half of it, their mean.
_PAIR = (
    f"{_FRAMES},\n{_LAGS},"
    + _shifts_to("SELECT scan_y AS y, scan_x AS x, count AS r FROM vx WHERE det_y = 4 AND det_x = 2", "0")
    + """,
bt AS (SELECT (shift_y - sh // 2) / 2 AS dy, (shift_x - sw // 2) / 2 AS dx FROM sq0, sz WHERE det_y = 4 AND det_x = 6),
mv AS (SELECT 2 AS det_x, -dy AS dy, -dx AS dx FROM bt UNION ALL SELECT 6, dy, dx FROM bt),
pp AS (SELECT det_x, y, x, y - dy AS sy, x - dx AS sx, sh, sw FROM mv, (SELECT y, unnest(range(0, sw)) AS x, sh, sw FROM (SELECT unnest(range(0, sh)) AS y, sh, sw FROM sz))),
pi_ AS (SELECT *, floor(sy) AS y0, floor(sx) AS x0 FROM pp WHERE sy BETWEEN 0 AND sh - 1 AND sx BETWEEN 0 AND sw - 1),
pc AS (SELECT p.y, p.x, p.det_x, sum((CASE WHEN scan_y = y0 THEN 1 - sy + y0 ELSE sy - y0 END) * (CASE WHEN scan_x = x0 THEN 1 - sx + x0 ELSE sx - x0 END) * count) AS v
  FROM pi_ p JOIN vx ON vx.det_y = 4 AND vx.det_x = p.det_x AND scan_y IN (y0, y0 + 1) AND scan_x IN (x0, x0 + 1) GROUP BY ALL),
pm AS (SELECT y, x, avg(v) AS v FROM pc GROUP BY ALL),"""
    + _shifts_to("SELECT g.y, g.x, coalesce(v, 0) AS r FROM (SELECT DISTINCT y, x FROM pp) g LEFT JOIN pm USING (y, x)")
    + """,
rg AS (SELECT * FROM sq WHERE (det_y - 4) ** 2 + (det_x - 4) ** 2 BETWEEN 4 AND 9)"""
)
#: Polynomials of degree 0 to 4 that are orthogonal on eight places (fixed values), and the part of the shifts that each of
#: their products explains; products are orthogonal on the 8 x 8 detector.
_ORTHOGONAL = (
    _SHIFTS
    + """,
op AS (SELECT k, t - 1 AS t, v[t] AS p FROM (SELECT *, unnest(range(1, 9)) AS t FROM (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest([[1, 1, 1, 1, 1, 1, 1, 1], [-7, -5, -3, -1, 1, 3, 5, 7],
  [7, 1, -3, -5, -5, -3, 1, 7], [-7, 5, 7, 3, -3, -7, -5, 7], [7, -13, -3, 9, 9, -3, -13, 7]]) AS v))),
ex AS (SELECT a.k + b.k AS degree, (sum(shift_y * a.p * b.p) ** 2 + sum(shift_x * a.p * b.p) ** 2) / sum(a.p * a.p * b.p * b.p) AS part
  FROM ce JOIN op a ON a.t = det_y JOIN op b ON b.t = det_x GROUP BY a.k, b.k)"""
)
#: Images on a grid twice as fine by cubic convolution (a = -0.75), rows first, mirrored at their ends.
_CUBIC = "CASE WHEN d <= 1 THEN (1.25::DOUBLE * d - 2.25::DOUBLE) * d * d + 1 ELSE ((-0.75::DOUBLE * d + 3.75::DOUBLE) * d - 6) * d + 3 END"
_FINE = "{t} AS (SELECT det_y, det_x, o, CAST(CASE WHEN m < n THEN m ELSE 2 * (n - 1) - m END AS INTEGER) AS src, " + _CUBIC + """ AS w FROM (
  SELECT *, ((f + k) % (2 * n - 2) + 2 * n - 2) % (2 * n - 2) AS m, abs(place - f - k) AS d FROM (SELECT *, CAST(floor(place) AS BIGINT) AS f FROM (
    SELECT *, o * (n - 1) / (2 * n - 1) - s AS place FROM (SELECT det_y, det_x, {s} AS s, {n} AS n, unnest(range(0, 2 * {n})) AS o FROM ce, sz))), (SELECT unnest(range(-1, 3)) AS k)))"""
_BICUBIC = (
    _SHIFTS
    + ",\n" + _FINE.format(t="wy", s="shift_y", n="sh") + ",\n" + _FINE.format(t="wx", s="shift_x", n="sw")
    + """,
rw AS (SELECT det_y, det_x, o AS y, scan_x, sum(w * count) AS c FROM vx JOIN wy USING (det_y, det_x) WHERE scan_y = src GROUP BY ALL),
cl AS (SELECT y, o AS x, sum(w * c) AS total FROM rw JOIN wx USING (det_y, det_x) WHERE scan_x = src GROUP BY ALL)"""
)


def _distorted() -> str:
    """Sums of the polynomials of fixtures.distorted(); a fit of their own order leaves nothing."""
    rows = []
    for size in (64, 256):
        for order in range(1, 6):
            y = " + ".join(["2 * u - v", *(f"u ** {d - 1} * v * 3 / {d}" for d in range(2, order + 1))])
            x = " - ".join(["v - u / 2", *(f"v ** {d} * 2 / {d}" for d in range(2, order + 1))])
            rows.append(f"""SELECT {size} AS size, {order} AS fit_order, count(*) AS n, 0.0::DOUBLE AS farthest, {_r(f'sum(abs({y}))', 'sum_y', 3)}, {_r(f'sum(abs({x}))', 'sum_x', 3)} FROM (
                SELECT DISTINCT (l_orderkey % {size} - {size // 2}) / {size / 2}::DOUBLE AS u, ((l_partkey * 31 + l_suppkey) % {size} - {size // 2}) / {size / 2}::DOUBLE AS v FROM lineitem)""")
    return " UNION ALL ".join(rows)


def _superres(shifts: str, threshold: float) -> str:
    """Shift-and-add of every pixel within three of the middle, on a grid twice as fine with a border of two."""
    return f"""
tg AS (SELECT v.det_y, v.det_x, frame_idx, count,
    CAST(least(greatest(round_even((scan_y - (shift_y - sh / 2 - 1.0)) * 2, 0), 0), sh * 2 + 3) AS INTEGER) AS ty, CAST(least(greatest(round_even((scan_x - (shift_x - sw / 2 - 1.0)) * 2, 0), 0), sw * 2 + 3) AS INTEGER) AS tx
  FROM vx v JOIN {shifts} s ON v.det_y = s.det_y AND v.det_x = s.det_x, sz WHERE quality > {threshold} AND abs(v.det_y - 4) <= 3 AND abs(v.det_x - 4) <= 3),
lw AS (SELECT det_y, det_x, ty, tx, arg_max(count, frame_idx) AS v FROM tg GROUP BY ALL),
hits AS (SELECT ty, tx, CAST(sum(v) AS DOUBLE) AS total, count(*) AS n FROM lw GROUP BY ALL),
big AS (SELECT CAST(y AS INTEGER) AS y, CAST(unnest(range(0, sw * 2 + 4)) AS INTEGER) AS x FROM (SELECT unnest(range(0, sh * 2 + 4)) AS y, sw FROM sz)),
sr AS (SELECT y, x, round(coalesce(total / n, 0), %d) + 0.0 AS value, coalesce(n, 0) AS n FROM big LEFT JOIN hits ON y = ty AND x = tx)"""


_OVERVIEW = "SELECT dataset_id, scan_y, scan_x, CAST(sum(count) AS BIGINT) AS value FROM {t} {w} GROUP BY ALL"
_VOXELS = "SELECT dataset_id, scan_y, scan_x, det_y, det_x, count FROM {t} {w}"


def _with(prelude: str, sql: str) -> str:
    return f"WITH {prelude.strip()}\n{sql}"


def _overview(prelude: str = _FRAMES, t: str = "vx", w: str = "") -> str:
    return _with(prelude, _OVERVIEW.format(t=t, w=w))


def _voxels(prelude: str = _FRAMES, t: str = "vx", w: str = "") -> str:
    return _with(prelude, _VOXELS.format(t=t, w=w))


_MASKED = "SELECT dataset_id, scan_y, scan_x, CAST(sum(CASE WHEN {c} THEN count ELSE 0 END) AS BIGINT) AS value FROM vx GROUP BY ALL"

def _r(x: str, n: str, d: int = 6) -> str:
    return f"round({x}, {d}) + 0.0 AS {n}"


_COMPARED = _DAMAGED + ", cp AS (SELECT v.dataset_id, v.scan_y, v.scan_x, v.det_y, v.det_x, v.count AS a, d.count AS b FROM vx v JOIN dm d USING (frame_idx, det_y, det_x))"
_FACTORS = "fc AS (SELECT *, unnest(list_filter([1, 2, 4, 8, 16, 32, 64, 128, 256, 512], lambda f: f <= {s} AND {s} % f = 0)) AS f FROM dz)"
_MIB = _FRAMES + ", mb AS (SELECT 'part-' || (frame_idx // 100) AS dataset_id, frame_idx % 100 AS frame_idx, count, det_y, det_x, frame_idx // 100 AS f FROM vx), mn AS (SELECT f, count(DISTINCT frame_idx) AS n FROM mb GROUP BY f)"
_POLY = ["1.0", "u", "v", "u*u", "u*v", "v*v", "u*u*u", "u*u*v", "u*v*v", "v*v*v"]
_MOMENTS = ", ".join(
    [_r(f"sum(w * ({_POLY[i]}) * ({_POLY[j]}))", f"m_{i}_{j}") for i in range(6) for j in range(i, 6)] + [_r(f"sum(w * ({_POLY[i]}) * shift_{n})", f"{n}_{i}") for n in "yx" for i in range(6)]
)
_PLANE = (
    _SHIFTS
    + """,
pl AS (SELECT avg(shift_y) AS ay, avg(shift_x) AS ax, sum((det_y - 3.5) * shift_y) / 336.0::DOUBLE AS uy, sum((det_y - 3.5) * shift_x) / 336.0::DOUBLE AS ux,
  sum((det_x - 3.5) * shift_y) / 336.0::DOUBLE AS vy, sum((det_x - 3.5) * shift_x) / 336.0::DOUBLE AS vx_ FROM ce)"""
)
_PROFILE = _PATTERN + ", rp AS (SELECT dataset_id, CAST(least(floor(sqrt((det_x - 4.0) ** 2 + (det_y - 4.0) ** 2)), {m}) AS INTEGER) AS r, avg(value) AS value FROM pt GROUP BY ALL)"
_GRAD = """, gr AS (SELECT dataset_id, r, coalesce((lead(value) OVER w - lag(value) OVER w) / 2, lead(value) OVER w - value, value - lag(value) OVER w, 0.0) AS g FROM {t} WINDOW w AS (PARTITION BY dataset_id ORDER BY r))"""

SQL: dict[str, str] = {
    # sources and sinks
    "read_mib": _with(_MIB, "SELECT dataset_id, frame_idx, CAST(frame_idx // w AS INTEGER) AS scan_y, CAST(frame_idx % w AS INTEGER) AS scan_x, CAST(sum(count) AS BIGINT) AS value, FALSE AS truncated FROM mb JOIN (SELECT f, CAST(max(n) // max(i) AS INTEGER) AS w FROM (SELECT f, n, unnest(range(1, CAST(floor(sqrt(n)) AS BIGINT) + 1)) AS i FROM mn) WHERE n % i = 0 GROUP BY f) USING (f) GROUP BY ALL"),
    "read_mib_rows": _with(_MIB, "SELECT dataset_id, frame_idx, CAST(count AS BIGINT) AS value FROM mb JOIN (SELECT f, max(n) // max(i) AS w FROM (SELECT f, n, unnest(range(1, CAST(floor(sqrt(n)) AS BIGINT) + 1)) AS i FROM mn) WHERE n % i = 0 GROUP BY f) USING (f) WHERE det_y = 1 AND det_x = 1 AND frame_idx // w = 2 AND frame_idx % w >= 3"),
    "mib_headers": _with(_MIB, "SELECT 'part-' || f AS dataset_id, n * 512 AS file_size, 384 AS header_bytes, 8 AS det_h, 8 AS det_w, 'U16' AS pixel, n AS n_frames, CAST(0 AS BIGINT) AS tail_bytes FROM mn"),
    "file_catalog": _with(_MIB, "SELECT 'part-' || f AS dataset_id, n AS n_frames, 8 AS det_h, 8 AS det_w, '4D_STEM' AS experiment_type, TRUE AS compatible, CAST(NULL AS VARCHAR) AS error FROM mn"),
    "read_cube": _overview(),
    "write_cube": _with(_FRAMES, "SELECT dataset_id, scan_y, scan_x, det_y, det_x, CAST(count AS BIGINT) AS count FROM vx"),
    "write_spectra": _with(_EELS, "SELECT dataset_id, scan_y, scan_x, 15 - det_x AS channel, CAST(sum(count) AS DOUBLE) AS value FROM vx GROUP BY ALL"),
    "verify_incomplete": _with(_SIZE, "SELECT unnest(['emb', 'cut', 'none']) AS dataset_id, n AS n_frames, unnest([n - (n + 6) // 7, n, 0]) AS found, FALSE AS ok FROM cnt"),
    "truncated_frames": _with(_SIZE, "SELECT n AS n_rows, CAST((n + 99) // 100 AS BIGINT) AS cut FROM cnt"),
    "export_structure": _with(
        _SIZE, "SELECT 'frames' AS \"table\", n AS n_rows, c AS \"column\", t AS type FROM cnt, (SELECT unnest(['dataset_id', 'frame_idx', 'scan_y', 'scan_x', 'det_h', 'det_w', 'counts']) AS c, unnest(['string', 'bigint', 'int', 'int', 'int', 'int', 'array<int>']) AS t)"
    ),
    "verify_written": _with(_SIZE, "SELECT 'emb' AS dataset_id, n AS n_frames, n AS found, TRUE AS ok FROM cnt"),
    "read_ndata": _with(_CONTEXT, """SELECT 'row-' || y AS dataset_id, CAST(0 AS INTEGER) AS y, x, CAST(value AS DOUBLE) AS value, '{"row": ' || y || '}' AS metadata FROM cx"""),
    "write_fft_result": _with(_DFT, f"SELECT dataset_id, det_y, det_x, ky, kx, {_r('re', 're', 4)}, {_r('im', 'im', 4)} FROM ft WHERE ky < 2 AND kx < 3"),
    "detect_results": _with(_DATASETS, "SELECT dataset_id, CASE WHEN n_frames % 3 = 0 THEN 'cropped' ELSE 'full' END AS mode FROM ds WHERE n_frames % 2 = 1"),
    "codec_study": _with(
        _FRAMES,
        """SELECT codec, layout, n * 128 AS raw_bytes, f AS frame_sum, p AS pixel_sum, r AS region_sum, TRUE AS ratio_of_files FROM cnt,
        (SELECT CAST(sum(CASE WHEN scan_y = 0 AND scan_x = 0 THEN count END) AS BIGINT) AS f, CAST(sum(CASE WHEN det_y = 4 AND det_x = 4 THEN count END) AS BIGINT) AS p,
          CAST(sum(CASE WHEN scan_y < (sh + 1) // 2 AND scan_x < (sw + 1) // 2 THEN count END) AS BIGINT) AS r FROM vx, sz),
        (SELECT unnest(['none', 'snappy', 'gzip', 'zstd', 'lz4_raw']) AS codec), (SELECT unnest(['frame', 'voxel', 'tile_frame', 'tile_pixel', 'tile_balanced']) AS layout)""",
    ),
    "rank_layouts": _with(
        _FRAMES,
        f"""SELECT codec, 'voxel' AS layout, size_bytes, {_r('2 * n / CAST(size_bytes AS DOUBLE)', 'ratio')}, CAST(row_number() OVER (ORDER BY 2 * n / CAST(size_bytes AS DOUBLE) DESC, codec) AS INTEGER) AS place
        FROM (SELECT count(*) AS n, unnest(['u16', 'u8', 'sparse']) AS codec, unnest([2 * count(*), count(*) + 13 * count(*) FILTER (count >= 255), 6 * count(*) FILTER (count > 0)]) AS size_bytes FROM vx)""",
    ),
    "read_tiles": _with(_FRAMES, "SELECT scan_y, scan_x, det_y, det_x, CAST(count AS BIGINT) AS count FROM vx WHERE scan_y BETWEEN 2 AND 8 AND scan_x BETWEEN 3 AND 11 AND det_y BETWEEN 1 AND 6 AND det_x <= 4"),
    "cached_slice": _with(_DFT, "SELECT count(*) AS n, round(sum(re), 1) + 0.0 AS re, TRUE AS few_groups FROM ft, sz WHERE ky < (sh + 3) // 4 AND kx < (sz.sw + 3) // 4 AND det_y < 3 AND det_x < 3"),
    "structure_statistics": _with(
        _FRAMES,
        " UNION ALL ".join(
            f"""SELECT 'frames' AS "table", '{c}' AS "column", (SELECT n FROM cnt) AS n_rows, CAST(count(*) AS BIGINT) AS n_values, CAST(0 AS BIGINT) AS nulls, CAST(min({v}) AS DOUBLE) AS lo, CAST(max({v}) AS DOUBLE) AS hi, {_r(f'avg({v})', 'mean', 4)}, {_r(f'stddev_pop({v})', 'sd', 4)} FROM {t}"""
            for c, v, t in (("counts", "count", "vx"), ("frame_idx", "frame_idx", "(SELECT DISTINCT frame_idx FROM vx)"), ("scan_y", "scan_y", "(SELECT DISTINCT frame_idx, scan_y FROM vx)"))
        ),
    ),
    "structure_inventory": _with(
        _SIZE,
        "SELECT 'frames' AS \"table\", n AS n_rows, c AS \"column\", t AS type FROM cnt, (SELECT unnest(['dataset_id', 'frame_idx', 'scan_y', 'scan_x', 'det_h', 'det_w', 'counts']) AS c, unnest(['string', 'bigint', 'int', 'int', 'int', 'int', 'array<int>']) AS t)"
        " UNION ALL SELECT 'sparse', n, c, t FROM cnt, (SELECT unnest(['dataset_id', 'frame_idx', 'scan_y', 'scan_x', 'det_h', 'det_w', 'idx', 'val']) AS c, unnest(['string', 'bigint', 'int', 'int', 'int', 'int', 'array<int>', 'array<int>']) AS t)",
    ),
    "run_stages": _with(_SIZE, "SELECT 'r1' AS run_id, 'emb' AS dataset_id, CAST(5 AS INTEGER) AS step_completed, TRUE AS has_bigft, FALSE AS has_correlations, CAST(64 AS BIGINT) AS n_images, CAST(64 AS BIGINT) AS n_shifts, CAST((sh * 4 + 16) * (sw * 4 + 16) AS BIGINT) AS n_pixels FROM sz"),
    "purge_runs": "SELECT 'r' || n_regionkey AS run_id, CAST(2 AS INTEGER) AS step_completed, 'bigft' AS stage, count(*) AS n_rows FROM nation WHERE n_regionkey % 2 = 0 GROUP BY n_regionkey",
    # metadata
    "frame_count": _with(_DATASETS, "SELECT dataset_id, CAST(file_size // (384 + 2 * CAST(det_h AS BIGINT) * det_w) AS BIGINT) AS frames FROM dz"),
    "infer_scan_size": _with(_DATASETS, "SELECT dataset_id, CAST(max(i) AS INTEGER) AS scan_h, CAST(max(n_frames) // max(i) AS INTEGER) AS scan_w FROM (SELECT dataset_id, n_frames, unnest(range(1, CAST(floor(sqrt(n_frames)) AS BIGINT) + 1)) AS i FROM ds) WHERE n_frames % i = 0 GROUP BY dataset_id"),
    "experiment_type": _with(_DATASETS, "SELECT dataset_id, CASE WHEN det_h <> det_w THEN 'EELS' ELSE '4D_STEM' END AS experiment_type, det_h <> det_w AND least(det_h, det_w) > 1 AS can_sum_y, det_h = det_w AS can_bin, CASE WHEN det_h <> det_w THEN 'EELS spectrometer' WHEN det_h >= 512 THEN 'Quad detector' ELSE 'Single detector' END AS detector, CASE WHEN det_h <> det_w AND least(det_h, det_w) > 1 THEN 'sum_y' WHEN det_h <> det_w THEN 'none' ELSE 'bin_2x2' END AS recommended FROM ds"),
    "valid_bin_factors": _with(_DATASETS + ", " + _FACTORS.format(s="det_h"), "SELECT dataset_id, CAST(f AS INTEGER) AS factor FROM fc"),
    "processed_shape": _with(_DATASETS, f"SELECT dataset_id, 1 AS out_h, CAST(det_w // 2 AS INTEGER) AS out_w, {_r('CAST(det_h AS DOUBLE) * det_w / (det_w // 2)', 'reduction')} FROM ds"),
    "storage_estimate": _with(
        _DATASETS,
        """SELECT dataset_id, codec, round(f, 3) AS out_bytes, round(file_size / f, 6) AS total_reduction, CAST(greatest(5, floor(file_size / 1073741824.0::DOUBLE * 10 * 1.2::DOUBLE)) AS INTEGER) AS seconds, round(file_size / 4.0::DOUBLE + 10485760, 3) + 0.0 AS eels_bytes
        FROM (SELECT *, CASE WHEN ratio > 1 THEN file_size / 4.0::DOUBLE / ratio ELSE file_size / 4.0::DOUBLE * 1.25 END AS f FROM dz, (SELECT unnest(['gzip-1', 'gzip-6', 'gzip-9', 'szip', 'lzf', 'none']) AS codec, unnest([20.1, 26.4, 28.9, 23.5, 14.0, 0.8]::DOUBLE[]) AS ratio))""",
    ),
    "fft_size_estimate": _with(_DATASETS, f"SELECT dataset_id, 2 * n_frames * det_h * det_w AS cube_bytes, 16 * n_frames * det_h * det_w AS fft_bytes, 16 * n_frames * least(det_h, 64) * least(det_w, 64) AS cropped_fft_bytes, {_r('CAST(det_h AS DOUBLE) * det_w / (least(det_h, 64) * least(det_w, 64))', 'reduction')} FROM ds"),
    "recommended_bin_factor": _with(
        _DATASETS + ", " + _FACTORS.format(s="least(det_h, det_w)") + ", op AS (SELECT *, CAST(ceil(sqrt(n_frames * det_h * det_w * 2 / (0.9::DOUBLE * 1048576))) AS INTEGER) AS optimum FROM fc)",
        "SELECT dataset_id, optimum, CAST(f AS INTEGER) AS bin_factor FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY abs(f - optimum), f) AS k FROM op) WHERE k = 1",
    ),
    "slice_sizes": _with(_DATASETS, "SELECT dataset_id, CAST(det_h AS BIGINT) * det_w * 2 AS pattern_bytes, n_frames * 2 AS pixel_image_bytes, CAST(det_w AS BIGINT) * 2 AS row_bytes FROM ds"),
    "default_detectors": _with(_DATASETS, "SELECT dataset_id, CAST(det_h // 2 AS INTEGER) AS cy, CAST(det_w // 2 AS INTEGER) AS cx, CAST(least(det_h, det_w) // 8 AS INTEGER) AS bf_radius, CAST(least(det_h, det_w) // 6 AS INTEGER) AS df_inner, CAST(least(det_h, det_w) // 4 AS INTEGER) AS df_outer FROM ds"),
    "latest_run": _with(_RUNS, "SELECT dataset_id, run_id, step_completed FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY ts DESC, run_id DESC) AS k FROM rn) WHERE k = 1"),
    "run_info": _with(_STAGES, "SELECT run_id, dataset_id, step_completed, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS size_bytes, coalesce(bool_or(stage = 'bigft'), FALSE) AS has_bigft, coalesce(bool_or(stage = 'correlations'), FALSE) AS has_correlations FROM rn LEFT JOIN st USING (run_id) GROUP BY run_id, dataset_id, step_completed"),
    "run_params_match": _with(
        _RUNS,
        """SELECT run_id, dataset_id, a AND b AS matches, concat_ws(',', CASE WHEN NOT a THEN 'radius' END, CASE WHEN NOT b THEN 'crop' END) AS differing
        FROM (SELECT run_id, dataset_id, CASE WHEN run_id % 4 <> 0 THEN run_id % 3 END IS NOT DISTINCT FROM CASE WHEN dataset_id % 4 <> 0 THEN dataset_id % 3 END AS a, run_id % 2 = dataset_id % 2 AS b FROM rn)""",
    ),
    "resume_stage": _with(_RUNS, "SELECT run_id, dataset_id, step_completed, ['fft', 'correlate', 'shifts', 'reconstruct'][step_completed] AS next_step FROM rn"),
    "invalidate_after": _with(_STAGES, "SELECT run_id, step, stage FROM st JOIN rn USING (run_id) WHERE step <= step_completed"),
    # selection
    "explode_voxels": _voxels(),
    "frames_from_voxels": _overview(_EVENTS, "ev"),
    "diffraction_pattern": _voxels(w=", sz WHERE scan_y = 3 AND scan_x = sw - 1"),
    "detector_pixel_image": _with(_FRAMES, "SELECT dataset_id, scan_y, scan_x, counts[3 * 8 + 5 + 1] AS value FROM fr"),
    "standard_bf": _with(_FRAMES, "SELECT dataset_id, scan_y, scan_x, count AS value FROM vx WHERE det_y = 4 AND det_x = 4"),
    "crop_detector": _with(_FRAMES, "SELECT dataset_id, scan_y, scan_x, det_y - 0 AS det_y, det_x - 1 AS det_x, count FROM vx WHERE det_y BETWEEN 0 AND 5 AND det_x BETWEEN 1 AND 6"),
    "crop_voxels": _with(_EVENTS, "SELECT dataset_id, scan_y, scan_x, det_y - 4 AS det_y, det_x - 2 AS det_x, count FROM ev WHERE det_y BETWEEN 4 AND 9 AND det_x BETWEEN 2 AND 8"),
    "crop_scan": _with(_FRAMES, "SELECT dataset_id, CAST(scan_y - (sh - 6) // 2 AS INTEGER) AS scan_y, CAST(scan_x - (sw - 9) // 2 AS INTEGER) AS scan_x, CAST(sum(count) AS BIGINT) AS value FROM vx, sz WHERE scan_y BETWEEN (sh - 6) // 2 AND (sh - 6) // 2 + 5 AND scan_x BETWEEN (sw - 9) // 2 AND (sw - 9) // 2 + 8 GROUP BY ALL"),
    "unscramble_eels": _voxels(_EELS),
    "flip_energy": _with(_EELS, "SELECT dataset_id, scan_y, scan_x, det_y, 15 - det_x AS det_x, count FROM vx"),
    "roi_filter": _overview(w="WHERE scan_y BETWEEN 2 AND 6 AND scan_x >= 3"),
    "roi_rotated": _overview(w="WHERE abs((scan_x - 12) * cos(radians(30)) + (scan_y - 10) * sin(radians(30))) <= 4.5 AND abs((scan_y - 10) * cos(radians(30)) - (scan_x - 12) * sin(radians(30))) <= 2"),
    "line_profile": _with(_FRAMES, "SELECT dataset_id, scan_y, scan_x, det_x AS channel, count AS value FROM vx WHERE det_y = 4"),
    "threshold_frame": _with(_FRAMES, "SELECT dataset_id, scan_y, scan_x, det_y, det_x, CASE WHEN count > 0.5 * max(count) OVER (PARTITION BY frame_idx) THEN count ELSE 0 END AS count FROM vx"),
    "threshold_mask": _with(_FRAMES, "SELECT dataset_id, scan_y, scan_x, det_y, det_x, CAST(count > lo + 0.5 * (hi - lo) AS INTEGER) AS count FROM (SELECT *, min(count) OVER w AS lo, max(count) OVER w AS hi FROM vx WINDOW w AS (PARTITION BY frame_idx))"),
    "fftshift_coords": _with(_FRAMES, "SELECT scan_y, scan_x, CAST((scan_y + sh // 2) % sh AS INTEGER) AS shown_y, CAST((scan_x + sw // 2) % sw AS INTEGER) AS shown_x, CAST((scan_x - sw // 2 + sw) % sw AS INTEGER) AS stored_x FROM fr, sz"),
    "first_frames": _overview(w="WHERE frame_idx < 100"),
    "pixel_difference": _with(_FRAMES, "SELECT dataset_id, scan_y, scan_x, 2 * counts[28] - counts[38] AS value FROM fr"),
    "disk_mask": _with(_PATTERN, _disk("SELECT 'disk' AS part, det_y, det_x, value FROM pt WHERE {d} <= 4 UNION ALL SELECT 'annulus', det_y, det_x, value FROM pt WHERE {d} BETWEEN 4 AND 9")),
    "masks_in_sql": _with(_PATTERN, _disk("SELECT 'disk' AS part, det_y, det_x, value FROM pt WHERE {d} <= 4 UNION ALL SELECT 'annulus', det_y, det_x, value FROM pt WHERE {d} BETWEEN 4 AND 9")),
    "last_write_per_target": _with(
        _FRAMES,
        "SELECT dataset_id, CAST((scan_y + det_y) // 2 AS INTEGER) AS y, CAST((scan_x + det_x) // 2 AS INTEGER) AS x, CAST(arg_max(count, ((det_y * 8 + det_x) * 100000 + scan_y) * 100000 + scan_x) AS INTEGER) AS value, count(*) AS n FROM (SELECT dataset_id, CAST(scan_y AS BIGINT) AS scan_y, CAST(scan_x AS BIGINT) AS scan_x, CAST(det_y AS BIGINT) AS det_y, CAST(det_x AS BIGINT) AS det_x, count FROM vx) GROUP BY 1, 2, 3",
    ),
    # joins and sets
    "apply_mask": _overview(w=_disk("WHERE {d} <= 4")),
    "apply_weights": _with(_FRAMES, _disk("SELECT dataset_id, scan_y, scan_x, CAST(sum(count * (det_y + 2 * det_x)) AS BIGINT) AS value FROM vx WHERE {d} BETWEEN 1 AND 9 GROUP BY ALL")),
    "mask_frames": _with(_FRAMES, _disk("SELECT dataset_id, scan_y, scan_x, CAST(sum(count * (det_y + 2 * det_x)) AS BIGINT) AS value FROM vx WHERE {d} BETWEEN 1 AND 9 GROUP BY ALL")),
    "region_ready": """SELECT run, region, bool_and(EXISTS (SELECT 1 FROM events e WHERE e.event_id = y * 50 + x AND (run = 2 OR e.event_id % 201 < 150))) AS ready
        FROM (SELECT run, CAST(r AS BIGINT) AS region, r + dy AS y, r + dx AS x FROM (SELECT unnest([1, 2]) AS run), range(30) t(r), range(3) a(dy), range(10) b(dx)) GROUP BY run, region""",
    "join_context_image": _with(_FRAMES, "SELECT dataset_id, scan_y, scan_x, CAST(sum(count) AS BIGINT) AS total, CAST(any_value(label) AS INTEGER) AS value FROM vx JOIN embeddings ON vec_id = frame_idx GROUP BY ALL"),
    "join_reference_fft": _with(_DFT, f"SELECT f.det_y, f.det_x, ky, kx, {_r('f.re * r.re + f.im * r.im', 're', 1)}, {_r('f.im * r.re - f.re * r.im', 'im', 1)} FROM ft f JOIN (SELECT ky, kx, re, im FROM ft WHERE det_y = 0 AND det_x = 0) r USING (ky, kx)"),
    "join_shift_map": _with(_SHIFTS, f"SELECT det_y, det_x, shift_y, shift_x, {_r('quality', 'quality')}, CAST(value AS DOUBLE) AS total FROM sf JOIN pt USING (det_y, det_x) WHERE quality > 0.3"),
    "compare_voxels": _with(
        _EVENTS,
        "SELECT dataset_id, scan_y, scan_x, det_y, det_x, CASE WHEN k = 1 THEN 0 ELSE count END AS a, CASE WHEN k = 2 THEN 0 ELSE count END AS b, k = 1 AS missing_a, k = 2 AS missing_b"
        " FROM (SELECT *, (scan_y + scan_x * 3 + det_y * 5 + det_x) % 7 AS k FROM ev) WHERE k IN (1, 2)",
    ),
    "sample_positions": _with(_FRAMES, "SELECT dataset_id, scan_y, scan_x FROM (SELECT DISTINCT dataset_id, scan_y, scan_x FROM vx) ORDER BY md5(concat_ws(',', '42', dataset_id, scan_y, scan_x)), 1, 2, 3 LIMIT 50"),
    "sampled_spectral_map": _with(
        _FRAMES,
        f"""SELECT dataset_id, scan_y, scan_x, {_r('avg(sqrt(re * re + im * im))', 'value', 4)} FROM (
          SELECT dataset_id, scan_y, scan_x, ky, kx, sum(count * cos(2 * pi() * (ky * det_y + kx * det_x) / 8.0::DOUBLE)) AS re, sum(count * sin(2 * pi() * (ky * det_y + kx * det_x) / 8.0::DOUBLE)) AS im
          FROM vx JOIN (SELECT dataset_id, scan_y, scan_x FROM (SELECT DISTINCT dataset_id, scan_y, scan_x FROM vx) ORDER BY md5(concat_ws(',', '42', dataset_id, scan_y, scan_x)), 1, 2, 3 LIMIT 25) USING (dataset_id, scan_y, scan_x),
            (SELECT unnest(range(0, 8)) AS ky), (SELECT unnest(range(0, 8)) AS kx) GROUP BY ALL) GROUP BY ALL""",
    ),
    "compare_cubes": _with(_COMPARED, "SELECT *, FALSE AS missing_a, FALSE AS missing_b FROM cp WHERE a <> b"),
    "sampled_match_rate": _with(_COMPARED, f"SELECT dataset_id, count(*) AS n, {_r('100 * avg(CAST(a = b AS INTEGER))', 'percent_equal')} FROM cp WHERE (scan_y * 7 + scan_x * 3 + det_y * 5 + det_x) % 11 = 0 GROUP BY dataset_id"),
    "interpolation_neighbours": _with(
        _CONTEXT,
        f"""SELECT c.dataset_id, c.y, c.x, {_r("0.5 * (0.75 * p.value + 0.25 * q.value) + 0.5 * (0.75 * r.value + 0.25 * s.value)", "value")}
        FROM cx c JOIN cx p ON p.y = c.y - 1 AND p.x = c.x JOIN cx q ON q.y = c.y - 1 AND q.x = c.x + 1 JOIN cx r ON r.y = c.y AND r.x = c.x JOIN cx s ON s.y = c.y AND s.x = c.x + 1""",
    ),
    "opposing_pixels": _with(_PATTERN, "SELECT det_y, det_x, 8 - det_y AS opp_y, 8 - det_x AS opp_x, value FROM pt WHERE ((det_x - 4) * (det_x - 4) + (det_y - 4) * (det_y - 4)) BETWEEN 4 AND 9 AND 8 - det_y < 8 AND 8 - det_x < 8 AND (det_y < 4 OR det_y = 4 AND det_x < 4)"),
    "distinct_positions": _with(_EVENTS, "SELECT DISTINCT dataset_id, scan_y, scan_x FROM ev ORDER BY 1, 2, 3 LIMIT 200"),
    "union_parts": _overview(),
    "missing_frames": _with(_ARRIVALS, "SELECT dataset_id, frame_idx FROM (SELECT dataset_id, unnest(range(0, n_frames)) AS frame_idx FROM ad) ANTI JOIN ar USING (dataset_id, frame_idx)"),
    "completeness": _with(_ARRIVALS, f"SELECT dataset_id, count(DISTINCT frame_idx) AS received, {_r('100 * count(DISTINCT frame_idx) / max(n_frames)', 'percent')}, count(DISTINCT CASE WHEN frame_idx < 3 THEN frame_idx END) = 3 AS region_ready FROM ad JOIN ar USING (dataset_id) GROUP BY dataset_id"),
    # aggregates
    "scan_overview": _overview(),
    "virtual_bf": _with(_FRAMES, _MASKED.format(c=_disk("{d} <= 1"))),
    "virtual_df": _with(_FRAMES, _MASKED.format(c=_disk("{d} BETWEEN 4 AND 9"))),
    "virtual_bf_events": _overview(_EVENTS, "ev", "WHERE (det_x - 8) * (det_x - 8) + (det_y - 8) * (det_y - 8) <= 25"),
    "mean_bf": _with(_FRAMES, f"SELECT dataset_id, scan_y, scan_x, {_r('avg(count)', 'value')} FROM vx GROUP BY ALL"),
    "energy_window_image": _overview(_EELS, w="WHERE det_x >= 10"),
    "roi_spectrum": _with(_EELS, f"SELECT dataset_id, det_x AS channel, {_r('avg(count)', 'value')} FROM vx WHERE scan_y BETWEEN 2 AND 10 AND scan_x BETWEEN 2 AND 10 GROUP BY ALL"),
    "sum_pattern": _with(_FRAMES, f"SELECT dataset_id, det_y, det_x, CAST(sum(count) AS BIGINT) AS total, {_r('avg(count)', 'mean')} FROM vx GROUP BY ALL"),
    "bin_detector": _with(_FRAMES, f"SELECT dataset_id, scan_y, scan_x, CAST(det_y // 2 AS INTEGER) AS det_y, CAST(det_x // 2 AS INTEGER) AS det_x, {_r('avg(count)', 'count')} FROM (SELECT dataset_id, scan_y, scan_x, det_y // 2 * 2 AS det_y, det_x // 2 * 2 AS det_x, count FROM vx) GROUP BY ALL"),
    "bin_detector_sum": _with(_FRAMES, "SELECT dataset_id, scan_y, scan_x, CAST(det_y // 4 AS INTEGER) AS det_y, CAST(det_x // 4 AS INTEGER) AS det_x, CAST(sum(count) AS BIGINT) AS count FROM (SELECT dataset_id, scan_y, scan_x, det_y // 4 * 4 AS det_y, det_x // 4 * 4 AS det_x, count FROM vx) GROUP BY ALL"),
    "sum_y": _with(_EELS, "SELECT dataset_id, scan_y, scan_x, 0 AS det_y, det_x, CAST(sum(count) AS BIGINT) AS count FROM vx GROUP BY ALL"),
    "process_cube": _with(_EELS, "SELECT dataset_id, scan_y, scan_x, 0 AS det_y, CAST(7 - b AS INTEGER) AS det_x, CAST(sum(count) AS BIGINT) AS count FROM (SELECT dataset_id, scan_y, scan_x, det_x // 2 AS b, count FROM vx) GROUP BY ALL"),
    "detector_energy": _with(_FRAMES, "SELECT dataset_id, det_y, det_x, CAST(sum(CAST(count AS BIGINT) * count) AS DOUBLE) AS norm FROM vx GROUP BY ALL"),
    "bf_center_com": _with(_FRAMES, f"SELECT dataset_id, {_r('sum(count * det_y) / CAST(sum(count) AS DOUBLE)', 'cy')}, {_r('sum(count * det_x) / CAST(sum(count) AS DOUBLE)', 'cx')} FROM vx WHERE frame_idx = 0 AND count > 0.6 * (SELECT max(count) FROM vx WHERE frame_idx = 0) GROUP BY dataset_id"),
    "bf_disk_bounds": _with(
        _PATTERN
        + """, a AS (SELECT dataset_id, CAST(floor(sum(value * det_y) / sum(value)) AS INTEGER) AS cy, CAST(floor(sum(value * det_x) / sum(value)) AS INTEGER) AS cx, (greatest(max(det_y) - min(det_y), max(det_x) - min(det_x)) + 2) // 2 AS half
          FROM pt, (SELECT min(value) AS lo, max(value) AS hi FROM pt) WHERE value > lo + 0.5 * (hi - lo) GROUP BY dataset_id),
        b AS (SELECT *, greatest(0, cy - half) AS y1, least(8, cy + half) AS y2, greatest(0, cx - half) AS x1, least(8, cx + half) AS x2 FROM a),
        c AS (SELECT *, (y1 + y2) // 2 AS my, (x1 + x2) // 2 AS mx, least(y2 - y1, x2 - x1) // 2 AS r FROM b)""",
        "SELECT dataset_id, CAST(greatest(0, my - r) AS INTEGER) AS y1, CAST(least(8, my + r) AS INTEGER) AS y2, CAST(greatest(0, mx - r) AS INTEGER) AS x1, CAST(least(8, mx + r) AS INTEGER) AS x2, cy, cx FROM c",
    ),
    "radial_profile": _with(_PROFILE.format(m=4), f"SELECT dataset_id, r, {_r('value', 'value')} FROM rp"),
    "radial_frequency_profile": _with(_PATTERN, f"SELECT 'emb' AS dataset_id, CAST(k AS INTEGER) AS r, {_r('coalesce(avg(value), 0)', 'value')} FROM (SELECT unnest(range(0, 4)) AS k) LEFT JOIN (SELECT value, floor(sqrt(((det_y + 4) % 8 - 4) ** 2 + ((det_x + 4) % 8 - 4) ** 2)) AS q FROM pt) ON q = k GROUP BY k"),
    "radial_gradient": _with(_PROFILE.format(m=100) + _GRAD.format(t="rp"), f"SELECT dataset_id, r, {_r('g', 'gradient')} FROM gr"),
    "bf_radius": _with(_PROFILE.format(m=100) + ", rq AS (SELECT * FROM rp WHERE r < (SELECT max(r) FROM rp))" + _GRAD.format(t="rq"), "SELECT dataset_id, r AS radius FROM (SELECT *, row_number() OVER (ORDER BY abs(g) DESC, r) AS k FROM gr) WHERE k = 1"),
    "histogram": _with(
        _FRAMES + ", im AS (" + _MASKED.format(c=_disk("{d} <= 4")) + ")",
        "SELECT dataset_id, CAST(least(floor((value - lo) / (CAST(hi - lo AS DOUBLE) / 100)) + 1, 100) AS INTEGER) AS bin, count(*) AS n FROM im, (SELECT min(value) AS lo, max(value) AS hi FROM im) GROUP BY ALL",
    ),
    "value_distribution": _with(_EVENTS, f"SELECT dataset_id, count(DISTINCT count) AS n_values, count(*) AS n, count(*) FILTER (WHERE count = 0) AS zeros, count(*) FILTER (WHERE count <= 50) AS low, {_r('count(*) FILTER (WHERE count = 0) / count(*)', 'zero_share')}, {_r('count(*) FILTER (WHERE count <= 50) / count(*)', 'low_share')} FROM ev GROUP BY dataset_id"),
    "sparsity": _with(_DAMAGED, f"SELECT dataset_id, {_r('avg(CAST(count = 0 AS INTEGER))', 'sparsity')} FROM dm GROUP BY dataset_id"),
    "quality_stats": _with(_SHIFTS, f"SELECT dataset_id, min(shift_y) AS min_y, max(shift_y) AS max_y, min(shift_x) AS min_x, max(shift_x) AS max_x, {_r('avg(quality)', 'mean_q')}, {_r('quantile_cont(quality, 0.5)', 'median_q')}, {_r('min(quality)', 'min_q')}, {_r('max(quality)', 'max_q')} FROM sf GROUP BY dataset_id"),
    "dataset_stats": _with(_FRAMES, f"SELECT dataset_id, min(count) AS lo, max(count) AS hi, {_r('avg(count)', 'mean')}, {_r('stddev_pop(count)', 'sd')} FROM vx GROUP BY dataset_id"),
    "cube_diff_stats": _with(_COMPARED, f"SELECT dataset_id, CAST(min(a - b) AS BIGINT) AS lo, CAST(max(a - b) AS BIGINT) AS hi, {_r('avg(a - b)', 'mean')}, {_r('stddev_pop(a - b)', 'sd')}, {_r('100 * avg(CAST(a <> b AS INTEGER))', 'percent_differing')}, count(*) FILTER (WHERE b = 0 AND a <> 0) AS zeroed_in_b, count(*) FILTER (WHERE a = 0 AND b <> 0) AS zeroed_in_a FROM cp GROUP BY dataset_id"),
    "corruption_by_radius": _with(_COMPARED + ", px AS (SELECT dataset_id, det_y, det_x FROM cp GROUP BY ALL HAVING sum(abs(a - b)) > 0)", "SELECT dataset_id, CAST(radius AS INTEGER) AS radius, count(*) FILTER (WHERE (det_y - 4) ** 2 + (det_x - 4) ** 2 > radius * radius) AS outside, count(*) AS differing FROM px, (SELECT unnest([1, 2, 4]) AS radius) GROUP BY ALL"),
    "all_zero_check": _with(_DATASETS, "SELECT dataset_id, n_frames % 2 = 0 AS all_zero FROM ds"),
    "residual_stats": _with(_SHIFTS, f"SELECT dataset_id, {_r('sqrt(avg(shift_y ** 2 + shift_x ** 2) / 2)', 'rmse_component')}, {_r('sqrt(avg(shift_y ** 2 + shift_x ** 2))', 'rmse_vector')}, {_r('avg(sqrt(shift_y ** 2 + shift_x ** 2))', 'mean')}, {_r('max(sqrt(shift_y ** 2 + shift_x ** 2))', 'greatest')}, {_r('stddev_pop(sqrt(shift_y ** 2 + shift_x ** 2))', 'sd')} FROM sf GROUP BY dataset_id"),
    "contrast_ratio": _with(
        _FRAMES + ", im AS (" + _MASKED.format(c=_disk("{d} <= 1")) + "), ce AS (SELECT scan_y, scan_x, count AS c FROM vx WHERE det_y = 4 AND det_x = 4)",
        f"SELECT dataset_id, {_r('stddev_pop(value) / stddev_pop(c)', 'ratio')}, {_r('sqrt(avg(CAST(value - c AS DOUBLE) ** 2))', 'rmse')} FROM im JOIN ce USING (scan_y, scan_x) GROUP BY dataset_id",
    ),
    "throughput_stats": f"SELECT CAST(l_orderkey % 10 AS VARCHAR) AS dataset_id, l_returnflag AS stage, CAST(sum(l_quantity) AS BIGINT) AS in_bytes, CAST(sum(l_linenumber) AS BIGINT) AS out_bytes, 2 * count(*) AS seconds, {_r('sum(l_quantity) / 1e6 / (2 * count(*))', 'mb_per_s')}, {_r('sum(l_quantity) / sum(l_linenumber)', 'ratio')} FROM lineitem GROUP BY ALL",
    "shape_check": "SELECT 'emb' AS dataset_id, TRUE AS extents_equal, FALSE AS is_spectra",
    "frame_pattern_check": _with(_FRAMES, f"SELECT dataset_id, {_r('avg(CAST(frame_idx % 40 <> 39 AS INTEGER))', 'share')}, avg(CAST(frame_idx % 40 <> 39 AS INTEGER)) >= 0.99 AS passes FROM fr GROUP BY dataset_id"),
    # windows and order
    "frame_order": _with(_ARRIVALS, "SELECT dataset_id, frame_idx, CAST(frame_idx // 25 AS INTEGER) AS scan_y, CAST(frame_idx % 25 AS INTEGER) AS scan_x FROM ar"),
    "top_detector_pixels": _with(_SHIFTS, f"SELECT dataset_id, det_y, det_x, {_r('quality', 'quality')}, quality > 0.5 AS used FROM (SELECT * FROM sf ORDER BY quality DESC, det_y, det_x LIMIT 10)"),
    "pixel_usage": _with(_SHIFTS, f"SELECT dataset_id, count(*) FILTER (WHERE quality > 0.5) AS used, count(*) FILTER (WHERE quality <= 0.5) AS skipped, {_r('max(quality)', 'best')} FROM sf GROUP BY dataset_id"),
    # scalar functions
    "complex_views": f"SELECT event_id, {_r('sqrt(a * a + b * b)', 'abs', 4)}, {_r('atan2(b, a)', 'phase', 4)}, {_r('a', 'real', 4)}, {_r('a * b + b * a', 'mul_re', 4)}, {_r('b * b - a * a', 'mul_im', 4)} FROM (SELECT event_id, value - 40 AS a, value * 0.5 - 10 AS b FROM events)",
    "log_scale": f"SELECT event_id, {_r('log10(greatest(abs(value), 1e-10))', 'log10_floor')}, {_r('log10(abs(value) + 1e-10)', 'log10_offset')}, {_r('ln(abs(value) + 1e-10)', 'ln_offset')}, {_r('ln(1 + abs(value))', 'log1p')}, {_r('sign(value - 40) * log10(abs(value - 40) + 1e-10)', 'signed_log10')} FROM events",
    "gamma_normalize": f"SELECT event_id, {_r('pow((value - lo) / (hi - lo), 0.8)', 'value')} FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)",
    "clip_and_round": "SELECT event_id, least(greatest(value, 10.0::DOUBLE), 60.0::DOUBLE) AS clipped, round_even(floor(value) + 0.5, 0) AS rounded FROM events",
    "vector_magnitude_angle": f"SELECT event_id, {_r('m', 'magnitude')}, {_r('degrees(atan2(a, b))', 'degrees')}, {_r('CASE WHEN m > 30 THEN a * (30 / m) ELSE a END', 'cy')}, {_r('CASE WHEN m > 30 THEN b * (30 / m) ELSE b END', 'cx')} FROM (SELECT event_id, value - 40 AS a, value - 20 AS b, sqrt((value - 40) ** 2 + (value - 20) ** 2) AS m FROM events)",
    "header_fields": _with(_DATASETS, "SELECT dataset_id, '00384' AS size, det_w AS w, det_h AS h, CAST(NULL AS INTEGER) AS none FROM ds"),
    "attr_json": _with(_DATASETS, """SELECT dataset_id, CASE WHEN n_frames % 2 = 0 THEN '{"frames":' || n_frames || '}' ELSE 'frames ' || n_frames END AS attr FROM ds"""),
    "run_timestamp": _with(_RUNS, "SELECT run_id, dataset_id || '_superres_' || strftime(ts, '%Y%m%d_%H%M%S') AS name, TRUE AS same FROM rn"),
    "saturating_split": _with(_EVENTS, "SELECT dataset_id, scan_y, scan_x, det_y, det_x, count * 20 AS count FROM ev WHERE count * 20 >= 255"),
    "overflow_encoding": _with(_EVENTS, f"SELECT dataset_id, count(*) AS n, count(*) FILTER (WHERE count * 20 >= 255) AS overflow, {_r('count(*) FILTER (WHERE count * 20 >= 255) / count(*)', 'share')}, {_r('2 * count(*) / (count(*) + 13 * count(*) FILTER (WHERE count * 20 >= 255))', 'ratio')} FROM ev GROUP BY dataset_id"),
    "sparse_frames": _with(_DAMAGED, "SELECT dataset_id, scan_y, scan_x, det_y, det_x, CAST(count AS BIGINT) AS count FROM dm"),
    "pixel_weights": _with(
        _PATTERN,
        f"""SELECT det_y, det_x, {_r("(0.5 - 0.5 * cos(2 * pi() * det_y / 7)) * (0.5 - 0.5 * cos(2 * pi() * det_x / 7))", "hann")},
        {_r("exp(-((det_y - 3.5) ** 2 + (det_x - 3.5) ** 2) / (2 * 2.4 ** 2))", "gauss")}, {_r("exp(-((det_y - 4) ** 2 + (det_x - 4) ** 2) / 64.0::DOUBLE)", "radial")} FROM pt""",
    ),
    "poly_terms": _with(_PATTERN, "SELECT det_y, det_x, " + ", ".join(f"{p}::DOUBLE AS t{k}" if k == 0 else f"{p} AS t{k}" for k, p in enumerate(_POLY)) + " FROM (SELECT *, CAST(det_y - 4 AS DOUBLE) AS u, CAST(det_x - 4 AS DOUBLE) AS v FROM pt)"),
    # spectra
    "fft_scan": _with(_FRAMES, "SELECT det_y, det_x, round(CAST(sum(CAST(count AS BIGINT) * count) AS DOUBLE), 0) + 0.0 AS energy FROM vx GROUP BY ALL"),
    "fft_strips": _with(_FRAMES, "SELECT det_y, det_x, round(CAST(sum(CAST(count AS BIGINT) * count) AS DOUBLE), 0) + 0.0 AS energy FROM vx GROUP BY ALL"),
    "ifft_strips": _with(_FRAMES, "SELECT det_y, det_x, scan_y AS y, scan_x AS x, CAST(count AS DOUBLE) + 0.0 AS value FROM vx"),
    "ifft_scan": _with(_FRAMES, "SELECT det_y, det_x, scan_y AS y, scan_x AS x, CAST(count AS DOUBLE) + 0.0 AS value FROM vx"),
    "pixel_images": _with(_FRAMES, "SELECT dataset_id, det_y, det_x, scan_y AS y, scan_x AS x, CAST(count AS DOUBLE) AS value FROM vx"),
    "dft_at": _with(_DFT, f"SELECT dataset_id, det_y, det_x, {_r('re', 're', 4)}, {_r('im', 'im', 4)} FROM ft WHERE ky = 3 AND kx = 5"),
    "freq_roi_pattern": _with(_DFT, f"SELECT dataset_id, det_y, det_x, {_r('sqrt(avg(re) ** 2 + avg(im) ** 2)', 'amplitude', 4)}, {_r('atan2(avg(im), avg(re))', 'phase', 4)} FROM ft, sz WHERE (ky = sh - 1 OR ky < 2) AND kx < 2 GROUP BY ALL"),
    "spatial_freq_map": _with(_DFT, f"SELECT dataset_id, ky, kx, {_r('avg(sqrt(re * re + im * im))', 'value', 4)}, {_r('ln(avg(sqrt(re * re + im * im)) + 1e-10)', 'ln', 4)} FROM ft GROUP BY ALL"),
    "amplitude_phase": _with(_DFT, f"SELECT dataset_id, det_y, det_x, ky, kx, {_r('sqrt(re * re + im * im)', 'amplitude', 3)}, {_r('abs(atan2(im, re))', 'phase', 3)} FROM ft"),
    "image_fft": _with(
        _CONTEXT + ", ks AS (SELECT ky, unnest(range(0, sw)) AS kx FROM (SELECT unnest(range(0, sh)) AS ky, sw FROM sz)), fi AS (SELECT dataset_id, ky, kx, sum(value * cos(a)) AS re, -sum(value * sin(a)) AS im FROM (SELECT cx.*, ky, kx, 2 * pi() * (ky * y / sh + kx * x / CAST(sw AS DOUBLE)) AS a FROM cx, ks, sz) GROUP BY ALL)",
        f"SELECT dataset_id, CAST((ky + sh // 2) % sh AS INTEGER) AS ky, CAST((kx + sw // 2) % sw AS INTEGER) AS kx, {_r('re', 're', 4)}, {_r('im', 'im', 4)}, {_r('sqrt(re * re + im * im)', 'magnitude', 4)} FROM fi, sz",
    ),
    # super-resolution
    "gaussian_smooth": _with(_FRAMES + "," + _SMOOTH, f"SELECT 'emb' AS dataset_id, det_y, det_x, y, x, {_r('value', 'value')} FROM sm"),
    "correlate_strips": _with(_CORR, f"SELECT det_y, det_x, lag_y, lag_x, {_r('corr', 'corr')} FROM co"),
    "cross_correlate": _with(_CORR, f"SELECT det_y, det_x, lag_y, lag_x, {_r('corr', 'corr')} FROM co"),
    "peak_argmax": _with(_CORR, f"SELECT det_y, det_x, peak_y, peak_x, {_r('peak', 'peak')} FROM pk"),
    "peak_neighbourhood": _with(_CORR, 'SELECT det_y, det_x, round(up, 6) + 0.0 AS up, round(down, 6) + 0.0 AS down, round("left", 6) + 0.0 AS "left", round("right", 6) + 0.0 AS "right" FROM nb'),
    "subpixel_quadratic": _with(_CORR, f"SELECT det_y, det_x, {_r('shift_y', 'shift_y', 4)}, {_r('shift_x', 'shift_x', 4)}, {_r('quality', 'quality', 4)} FROM sq"),
    "shift_maps": _with(_CORR, f"SELECT det_y, det_x, {_r('shift_y', 'shift_y', 4)}, {_r('shift_x', 'shift_x', 4)}, {_r('quality', 'quality', 4)} FROM sq"),
    "subpixel_lstsq": _with(
        _CORR
        + """, ab AS (SELECT *, (c00 + c02 + c20 + c22 + "left" + "right" - 2 * (up + down + peak)) / 6 AS a, (c00 + c02 + c20 + c22 + up + down - 2 * ("left" + "right" + peak)) / 6 AS b, (c00 + c22 - c02 - c20) / 4 AS c,
          (c02 + c22 + "right" - c00 - c20 - "left") / 6 AS d, (c20 + c22 + down - c00 - c02 - up) / 6 AS e FROM si)""",
        f"SELECT det_y, det_x, {_r('CASE WHEN inside THEN peak_y + coalesce((c * d - 2 * a * e) / nullif(4 * a * b - c * c, 0), 0) ELSE peak_y END', 'shift_y', 4)}, {_r('CASE WHEN inside THEN peak_x + coalesce((c * e - 2 * b * d) / nullif(4 * a * b - c * c, 0), 0) ELSE peak_x END', 'shift_x', 4)}, {_r('peak', 'quality', 4)} FROM ab",
    ),
    "center_shifts": _with(_SHIFTS, "SELECT det_y, det_x, shift_y, shift_x FROM ce"),
    "center_shifts_on_pixel": _with(_SHIFTS, "SELECT a.det_y, a.det_x, a.shift_y - b.shift_y AS shift_y, a.shift_x - b.shift_x AS shift_x FROM sf a, (SELECT shift_y, shift_x FROM sf WHERE det_y = 4 AND det_x = 4) b"),
    "fit_moments": _with(_SHIFTS, f"SELECT {_MOMENTS} FROM (SELECT *, det_y - 4.0::DOUBLE AS u, det_x - 4.0::DOUBLE AS v, quality + 1e-12 AS w FROM ce)"),
    "fit_distortion": _with(_PLANE, f"SELECT CAST(0 AS INTEGER) AS term, {_r('ay', 'coef_y', 8)}, {_r('ax', 'coef_x', 8)} FROM pl UNION ALL SELECT 1, {_r('uy', 'coef_y', 8)}, {_r('ux', 'coef_x', 8)} FROM pl UNION ALL SELECT 2, {_r('vy', 'coef_y', 8)}, {_r('vx_', 'coef_x', 8)} FROM pl"),
    "distortion_residuals": _with(_PLANE, f"SELECT det_y, det_x, {_r('shift_y - ay - uy * (det_y - 3.5) - vy * (det_x - 3.5)', 'ry', 8)}, {_r('shift_x - ax - ux * (det_y - 3.5) - vx_ * (det_x - 3.5)', 'rx', 8)} FROM ce, pl"),
    "fit_distortion_orders": _distorted(),
    "best_order": _with(_ORTHOGONAL, f"SELECT CAST(fit_order AS INTEGER) AS fit_order, {_r('sqrt(((SELECT sum(shift_y ** 2 + shift_x ** 2) FROM ce) - sum(part)) / 64)', 'rmse_vector', 4)} FROM ex JOIN (SELECT unnest([1, 2, 3, 4]) AS fit_order) ON degree <= fit_order GROUP BY fit_order"),
    "reconstruct_superres": _with(_SHIFTS + "," + _superres("sf", 0.3) % 6, "SELECT y, x, value, n FROM sr"),
    "contribution_map": _with(_SHIFTS + "," + _superres("sf", 0.3) % 6, "SELECT y, x, n AS value FROM sr"),
    "superres_pipeline": _with(_CORR + "," + _superres("sq", 0.01) % 4, "SELECT y, x, value, n FROM sr"),
    "align_bilinear": _with(
        _SHIFTS
        + """,
        pos AS (SELECT c.det_y, c.det_x, y, x, y - shift_y AS sy, x - shift_x AS sx FROM ce c, (SELECT y, unnest(range(0, sw)) AS x FROM (SELECT unnest(range(0, sh)) AS y, sw FROM sz))),
        ins AS (SELECT *, floor(sy) AS y0, floor(sx) AS x0 FROM pos, sz WHERE sy BETWEEN 0 AND sh - 1 AND sx BETWEEN 0 AND sw - 1),
        cor AS (SELECT det_y, det_x, y, x, y0 + a AS py, x0 + b AS px, (CASE WHEN a = 1 THEN sy - y0 ELSE 1 - sy + y0 END) * (CASE WHEN b = 1 THEN sx - x0 ELSE 1 - sx + x0 END) AS w FROM ins, (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b)),
        val AS (SELECT cor.y, cor.x, sum(w * count) AS total, count(DISTINCT (cor.det_y, cor.det_x)) AS n FROM cor JOIN vx v ON v.det_y = cor.det_y AND v.det_x = cor.det_x AND scan_y = py AND scan_x = px WHERE w <> 0 GROUP BY ALL)""",
        f"SELECT CAST(g.y AS INTEGER) AS y, CAST(g.x AS INTEGER) AS x, {_r('coalesce(total / n, 0)', 'value')}, coalesce(n, 0) AS n FROM (SELECT DISTINCT y, x FROM pos) g LEFT JOIN val USING (y, x)",
    ),
    "align_nearest": _with(
        _SHIFTS + ", pos AS (SELECT det_y, det_x, y, x, round_even(y + shift_y + 0.25, 0) AS py, round_even(x + shift_x + 0.25, 0) AS px FROM ce, (SELECT y, unnest(range(0, sw)) AS x FROM (SELECT unnest(range(0, sh)) AS y, sw FROM sz))), val AS (SELECT y, x, sum(count) AS total, count(*) AS n FROM pos JOIN vx USING (det_y, det_x) WHERE scan_y = py AND scan_x = px AND count <> 0 GROUP BY ALL)",
        f"SELECT CAST(g.y AS INTEGER) AS y, CAST(g.x AS INTEGER) AS x, {_r('coalesce(total / n, 0)', 'value')}, coalesce(n, 0) AS n FROM (SELECT DISTINCT y, x FROM pos) g LEFT JOIN val USING (y, x)",
    ),
    "align_bicubic": _with(_BICUBIC, f"SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {_r('total / 64', 'value')}, CAST(64 AS BIGINT) AS n FROM cl"),
    "adf_pairwise": _with(_PAIR + "," + _superres("rg", 0.01) % 4, "SELECT y, x, value, n FROM sr"),
    "virtual_adf_reference": _with(_FRAMES, _disk("SELECT CAST(frame_idx AS INTEGER) AS k, CAST(sum(count) AS DOUBLE) AS value FROM vx WHERE {d} BETWEEN 4 AND 9 GROUP BY frame_idx")),
    # streams
    "read_frames_stream": _overview(),
    "progressive_spectra": _with(_EELS, "SELECT dataset_id, scan_y, scan_x, 0 AS det_y, 15 - det_x AS det_x, CAST(sum(count) AS BIGINT) AS count FROM vx GROUP BY ALL"),
    "live_virtual_images": _with(_FRAMES, f"SELECT dataset_id, scan_y, scan_x, CAST(sum(CASE WHEN {_disk('{d} <= 1')} THEN count ELSE 0 END) AS BIGINT) AS bf, CAST(sum(CASE WHEN {_disk('{d} BETWEEN 4 AND 9')} THEN count ELSE 0 END) AS BIGINT) AS df FROM vx GROUP BY ALL"),
    "late_duplicate_frames": _with(_ARRIVALS, "SELECT DISTINCT dataset_id, frame_idx FROM ar"),
    "stop_resume": _with(_ARRIVALS, "SELECT DISTINCT dataset_id, frame_idx FROM ar"),
    "progress_metrics": "SELECT CAST(run AS INTEGER) AS run, count(*) AS rows, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM events), 6) + 0.0 AS percent FROM (SELECT unnest([1, 2]) AS run), events WHERE event_id % 2 < run GROUP BY run",
    "completion_state": _with(_ARRIVALS, f"SELECT dataset_id, count(DISTINCT frame_idx) AS received, {_r('100 * count(DISTINCT frame_idx) / max(n_frames)', 'percent')} FROM ad JOIN ar USING (dataset_id) GROUP BY dataset_id"),
}
